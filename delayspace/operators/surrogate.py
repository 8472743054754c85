"""Surrogate series for significance tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..sources.scratch import cut, ranked
from ..sources.series import ONE_TASK, ROW, Series, quoted
from .fourier import transform

METHODS = ("random_shuffle", "ebisuzaki", "seasonal")
#: Values of a series that is broadcast and transformed at once.
VALUES = 100_000
#: Phases of a cycle that are broadcast at most.
PHASES = 200_000


def shuffle(series: Series, column: str, num_surr: int, seed: int) -> DataFrame:
    """Independent permutations: each surrogate ranks the rows by a hash of (seed, surrogate, row)."""
    values = series.df.select(ROW, quoted(column).alias("value"))
    many = values.withColumn("surr_id", F.explode(F.sequence(F.lit(1), F.lit(num_surr))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("surr_id").cast("string"), F.col(ROW).cast("string")))
    if series.n <= ONE_TASK:
        place = F.row_number().over(W.partitionBy("surr_id").orderBy(key, ROW)).cast("long")
        return many.select("surr_id", place.alias(ROW), "value")
    # all surrogates in one order, by ranges; each has as many rows as the series
    keyed = many.select("surr_id", key.alias("_key"), ROW, "value")
    placed = ranked(keyed, "surr_id", "_key", ROW, name="_rank", label="shuffled", parts=-(-series.n * num_surr // ONE_TASK))
    return placed.select("surr_id", (F.col("_rank") - (F.col("surr_id") - 1) * F.lit(series.n) + 1).alias(ROW), "value")


def phase_randomised(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same amplitudes with random phases, mean zero, and the sample deviation of ``x``."""
    n = len(x)
    spectrum = np.abs(np.fft.rfft(x))
    spectrum[0] = 0
    phases = np.exp(2j * np.pi * rng.random(len(spectrum)))
    coded = spectrum * phases
    if n % 2 == 0:
        # the middle frequency of an even length is real; its root of two keeps the variance as expected
        coded[-1] = np.sqrt(2) * spectrum[-1] * np.cos(2 * np.pi * rng.random())
    out = np.fft.irfft(coded, n)
    spread = out.std(ddof=1)
    return out / spread * x.std(ddof=1) if spread > 0 else out


#: Numbers that the spline's elimination holds at once.
HELD = 30_000_000


class Spline:
    """A natural cubic smoothing spline through means y of weight w at distinct x, by banded elimination: time and memory go with the number of places.

    With second derivatives g at the inner places, (R + penalty M) g = Q' y, where M = Q' W^-1 Q; fitted values are y - penalty W^-1 Q g. All of these have
    five bands at most, and so do the parts of the inverse that the trace of the smoother takes.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        h = np.diff(x)
        a, c = 1 / h[:-1], 1 / h[1:]
        b = -a - c
        self.q, self.y, self.w = (a, b, c), y, w
        self.r = ((h[:-1] + h[1:]) / 3, h[1:-1] / 6, np.zeros(max(0, len(h) - 3)))
        self.m = (a * a / w[:-2] + b * b / w[1:-1] + c * c / w[2:], b[:-1] * a[1:] / w[1:-2] + c[:-1] * b[1:] / w[2:-1], c[:-2] * a[2:] / w[2:-2])
        self.second = a * y[:-2] + b * y[1:-1] + c * y[2:]

    def eliminated(self, penalty: np.ndarray, of_r: float = 1.0):
        """(second derivatives, trace of the inverse times M) for each penalty, or with the inverse of R alone where all are 0."""
        n, k = len(self.second), len(penalty)
        d, u, v, z = (np.zeros((n + 2, k)) for _ in range(4))
        for j in range(n):  # places before the first are zero
            d[j] = self.r[0][j] + penalty * self.m[0][j] - u[j - 1] ** 2 * d[j - 1] - v[j - 2] ** 2 * d[j - 2]
            z[j] = self.second[j] - u[j - 1] * z[j - 1] - v[j - 2] * z[j - 2]
            if j + 1 < n:
                u[j] = (self.r[1][j] + penalty * self.m[1][j] - v[j - 1] * d[j - 1] * u[j - 1]) / d[j]
            if j + 2 < n:
                v[j] = penalty * self.m[2][j] / d[j]
        g, trace = np.zeros((n + 2, k)), np.zeros(k)
        s0, s1, s0_next = np.zeros(k), np.zeros(k), np.zeros(k)  # of the row below: inverse at (j + 1, j + 1), (j + 1, j + 2), (j + 2, j + 2)
        for j in range(n - 1, -1, -1):
            g[j] = z[j] / d[j] - u[j] * g[j + 1] - v[j] * g[j + 2]
            two = -u[j] * s1 - v[j] * s0_next
            one = -u[j] * s0 - v[j] * s1
            own = 1 / d[j] - u[j] * one - v[j] * two
            trace += own * self.m[0][j]
            if j + 1 < n:
                trace += 2 * one * self.m[1][j]
            if j + 2 < n:
                trace += 2 * two * self.m[2][j]
            s0, s1, s0_next = own, one, s0
        return g[:n], trace

    def bent(self, g: np.ndarray) -> np.ndarray:
        """Q g."""
        out = np.zeros((len(self.y), g.shape[1]))
        for shift, band in enumerate(self.q):
            out[shift : shift + len(g)] += band[:, None] * g
        return out


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray, scatter: float = 0.0):
    """Fitted values of a :class:`Spline` whose penalty is chosen by generalised cross validation.

    The weights count values, of which ``scatter`` is the sum of squares about their means.
    """
    n = len(x)
    if n < 4:
        return y.copy()
    spline = Spline(x, y, w)
    scale = spline.eliminated(np.zeros(1))[1][0] / (n - 2)
    penalties, best = np.logspace(-8, 8, 161) / (scale if scale > 0 else 1.0), None
    for part in np.array_split(penalties, max(1, min(161, -(-161 * 5 * n // HELD)))):
        g, trace = spline.eliminated(part)
        off = part * spline.bent(g) / w[:, None]
        rest, free = (w[:, None] * off * off).sum(axis=0), w.sum() - (n - part * trace)
        score = np.where(free > 1e-6, w.sum() * (rest + scatter) / np.maximum(free, 1e-12) ** 2, np.inf)
        at = int(np.argmin(score))
        if np.isfinite(score[at]) and (best is None or score[at] < best[0]):
            best = (score[at], y - off[:, at])
    return best[1] if best else y.copy()


def cycle_of(phase: np.ndarray, means: np.ndarray, weights: np.ndarray, scatter: float, period: int) -> np.ndarray:
    """A smooth cycle at phases, from the means of the values there, laid out over three periods."""
    places = np.concatenate((phase - period, phase, phase + period)).astype(float)
    return smoothing_spline(places, np.tile(means, 3), np.tile(weights, 3), 3 * scatter)[len(phase) : 2 * len(phase)]


def _smooth(period: int):
    schema = pa.schema([("_phase", pa.int64()), ("_cycle", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_phase")
        phase, mean, n, scatter = (np.asarray(table.column(c).combine_chunks()) for c in ("_phase", "_mean", "_n", "_scatter"))
        return pa.Table.from_arrays([pa.array(phase), pa.array(cycle_of(phase, mean, n.astype(float), float(scatter.sum()), period))], schema=schema)

    return run


def seasonal(series: Series, column: str, num_surr: int, period: int, alpha: float, seed: int) -> DataFrame:
    """A smooth cycle, and shuffled residuals. Values are averaged by phase where they are; only a row for each phase meets in one task."""
    if period < 1:
        raise ValueError("surrogate_data: a period has one row or more")
    values = series.df.select(ROW, finite(quoted(column)).alias("value"), F.pmod(F.col(ROW) - 1, F.lit(period)).alias("_phase"))
    by_phase = values.groupBy("_phase").agg(F.avg("value").alias("_mean"), F.count("*").alias("_n"), (F.var_pop("value") * F.count("*")).alias("_scatter"))
    cycle = cut(by_phase.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(_smooth(period), "_phase long, _cycle double"), "cycle")
    cycle = F.broadcast(cycle) if period <= PHASES else cycle
    rest = values.join(cycle, "_phase").select(ROW, (F.col("value") - F.col("_cycle")).alias("value"))
    moved = shuffle(Series(rest, series.time, series.n), "value", num_surr, seed)
    draw = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "surr_id", ROW), F.lit(1 << 52)) + 0.5) / (1 << 52)
    noise = alpha * F.sqrt(-2 * F.log(draw(1))) * F.cos(2 * np.pi * draw(2)) if alpha else F.lit(0.0)
    placed = moved.withColumn("_phase", F.pmod(F.col(ROW) - 1, F.lit(period))).join(cycle, "_phase")
    return placed.select("surr_id", ROW, (F.col("_cycle") + F.col("value") + noise).alias("value"))


def _transformed(held, seed: int):
    schema = pa.schema([("surr_id", pa.int32()), (ROW, pa.int64()), ("value", pa.float64())])

    def run(batches):
        x = held.value
        for b in batches:
            for surr in b.column("surr_id").to_pylist():
                out = phase_randomised(x, np.random.default_rng([seed, surr]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), surr, np.int32)), pa.array(np.arange(1, len(x) + 1)), pa.array(out)], schema=schema)

    return run


def phases_by_steps(series: Series, column: str, num_surr: int, seed: int) -> DataFrame:
    """As :func:`phase_randomised`, for a series that no task has to hold. Phases are hashes of seed, surrogate and frequency."""
    n = series.n
    x = series.df.select((F.col(ROW) - 1).alias("i"), quoted(column).cast("double").alias("re"), F.lit(0.0).alias("im"))
    size = transform(x, n).where(F.col("i") <= n // 2).select("i", F.hypot("re", "im").alias("size"))
    size = cut(size, "spectrum")
    draw = F.pmod(F.xxhash64(F.lit(seed), "surr_id", "i"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = size.where("i > 0").withColumn("surr_id", F.explode(F.sequence(F.lit(1), F.lit(num_surr)))).withColumn("turn", 2 * np.pi * draw)
    middle = (F.col("i") * 2 == n)
    re = F.col("size") * F.cos("turn") * F.when(middle, float(np.sqrt(2))).otherwise(1.0)
    half = drawn.select("surr_id", "i", re.alias("re"), F.when(middle, 0.0).otherwise(F.col("size") * F.sin("turn")).alias("im"))
    # the other half of the frequencies of real numbers
    whole = half.union(half.where(F.col("i") * 2 < n).select("surr_id", (n - F.col("i")).alias("i"), "re", -F.col("im")))
    made = cut(transform(whole, n, ["surr_id"], True).select("surr_id", (F.col("i") + 1).alias(ROW), F.col("re").alias("value")), "surrogates")
    spread = x.agg(F.stddev_samp("re")).head()[0] or 0.0
    own = F.broadcast(made.groupBy("surr_id").agg(F.stddev_samp("value").alias("_spread")))
    scaled = F.when(F.col("_spread") > 0, F.col("value") / F.col("_spread") * spread).otherwise(F.col("value"))
    return made.join(own, "surr_id").select("surr_id", ROW, scaled.alias("value"))


def surrogate_data(series: Series, column: str, method: str = "random_shuffle", num_surr: int = 100, T_period: int = 1, alpha: float = 0, seed: int = 0) -> DataFrame:
    """(surr_id, row_id, value) of ``num_surr`` surrogates of a column.

    random_shuffle permutes; ebisuzaki keeps the power spectrum and the variance, with mean zero; seasonal adds shuffled residuals and noise of
    deviation ``alpha`` to a smooth cycle of T_period rows. The last two need finite values. Draws are hashes of seed, surrogate and row, or a surrogate's own
    generator's, so results do not depend on how tasks are dealt.
    """
    if method not in METHODS:
        raise ValueError(f"surrogate_data: unknown method {method}")
    if method == "random_shuffle":
        return shuffle(series, column, num_surr, seed)
    spark = series.df.sparkSession
    odd = series.df.agg(F.count("*") - F.count(finite(quoted(column)))).head()[0]
    if odd or not series.n:
        raise ValueError("surrogate_data: the series has values that are missing or not finite")
    if method == "seasonal":
        return seasonal(series, column, num_surr, T_period, alpha, seed)
    if series.n > VALUES:
        return phases_by_steps(series, column, num_surr, seed)
    rows = series.df.select(ROW, finite(quoted(column)).alias("value")).orderBy(ROW).toArrow()
    x = rows.column("value").to_numpy(zero_copy_only=False).astype(float)
    table = spark.range(1, num_surr + 1).select(F.col("id").cast("int").alias("surr_id"))
    return table.mapInArrow(_transformed(spark.sparkContext.broadcast(x), seed), f"surr_id int, {ROW} long, value double")


def wide(surrogates: DataFrame, num_surr: int, time: DataFrame | None = None) -> DataFrame:
    """One column ``surr_k`` for each surrogate, after the columns of ``time`` (which has row_id)."""
    out = surrogates.groupBy(ROW).pivot("surr_id", list(range(1, num_surr + 1))).agg(F.first("value"))
    out = out.select(ROW, *[quoted(str(k)).alias(f"surr_{k}") for k in range(1, num_surr + 1)])
    return (time.join(out, ROW) if time is not None else out).orderBy(ROW)
