"""S-map: a local linear map for every predicted row, weighted by distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.args import without_local
from ..functions.kernels import CELLS, eligible, k_first, map_factors, smap_rows, solved_maps, triangles
from ..plans.index import within
from ..sources.scratch import cut
from ..sources.series import ROW, write_csv
from .layout import layout
from .neighbors import TILE, _of, _states, neighbors
from .state import Result, State, prepare, state_frames

#: Pairs of a tile, about, and tiles whose factors meet in one step.
WORK, FAN_IN = 8_000_000, 64
_MAPS = "p long, theta double, pred double, var double, c array<double>, s array<double>"
_SCHEMA = pa.schema([("p", pa.int64()), ("theta", pa.float64()), ("pred", pa.float64()), ("var", pa.float64()), ("c", pa.list_(pa.float64())), ("s", pa.list_(pa.float64()))])


def default_knn(state: State, knn: int) -> int:
    """All library rows but one; one less than are left where missing values shortened the library."""
    if knn:
        return knn
    whole = state.vectors.where(within(state.indices.lib, F.col(ROW)) & F.col("ok")).count()
    return min(state.indices.n_lib, whole) - 1


def _told(p_rows: np.ndarray, theta: np.ndarray, got: np.ndarray, var: np.ndarray, c: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]).astype(np.int32)), pa.array(x.ravel(), from_pandas=True))
    return pa.RecordBatch.from_arrays([pa.array(p_rows), pa.array(theta), pa.array(got, from_pandas=True), pa.array(var, from_pandas=True), lists(c), lists(s)], schema=_SCHEMA)


def _whole(dims: int, k: int, radius: int, thetas: list[float]):
    """Maps of some predicted rows from a library that is all in the tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCHEMA.empty_table()
        p_rows, a = _of(left, "p"), _states(left, "a", dims)
        maps = smap_rows(p_rows, a, _of(right, "l"), _states(right, "b", dims), _numbers(right, "y"), k, radius, thetas)
        return pa.Table.from_batches([_told(p_rows[at], np.full(len(at), theta), *rest) for at, theta, *rest in maps], schema=_SCHEMA)

    return run


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    """A column of doubles, null as not a number."""
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(float)


def _farthest(dims: int, most: int, radius: int):
    """Of each predicted row in a tile: how many library rows it may use, their distances' sum, and the ``most`` last of them."""
    places = [("d", pa.float64()), ("gap", pa.int64()), ("l", pa.int64())]
    schema = pa.schema([("p", pa.int64()), ("n", pa.int64()), ("total", pa.float64()), *[(c, pa.list_(t)) for c, t in places]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        p_rows, a, l_rows, b = _of(left, "p"), _states(left, "a", dims), _of(right, "l"), _states(right, "b", dims)
        step = max(1, CELLS // max(1, len(b)))
        for at in range(0, len(a), step):
            d, gap = eligible(p_rows[at : at + step], a[at : at + step], l_rows, b, radius)
            there = d < np.inf
            n = there.sum(axis=1)
            last = there & ~k_first(d, gap, l_rows, len(b) - most) if most < len(b) and (n == len(b)).all() else _last(d, gap, l_rows, n, most)
            i, j = np.nonzero(last)
            offsets = pa.array(np.concatenate(([0], np.cumsum(last.sum(axis=1)))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (d[i, j], gap[i, j], l_rows[j])]
            out.append(pa.Table.from_arrays([pa.array(p_rows[at : at + step]), pa.array(n.astype(np.int64)), pa.array(np.where(there, d, 0).sum(axis=1)), *lists], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _last(d: np.ndarray, gap: np.ndarray, l_rows: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Which are each row's ``most`` last finite distances by (distance, row difference, row), a row at a time."""
    out = np.zeros(d.shape, bool)
    for r in range(len(d)):
        order = np.lexsort((l_rows, gap[r], d[r]))[: n[r]]
        out[r, order[max(0, n[r] - most) :]] = True
    return out


def _bounds(pred: DataFrame, lib: DataFrame, dims: int, k: int, radius: int, n_pred: int, n_lib: int, tiles) -> DataFrame:
    """(p, mean, d, gap, l) of each predicted row: the mean distance of its k neighbours, and the last of them; d is infinite if all rows are."""
    if 2 * k <= n_lib:
        near = neighbors(pred, lib, dims, k, radius, n_pred, n_lib)
        last = F.max(F.struct("d", F.abs(F.col("p") - F.col("l")).alias("gap"), "l")).alias("x")
        found = near.groupBy("p").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), last)
        return found.select("p", "mean", *[F.col(f"x.{c}").alias(c) for c in ("d", "gap", "l")])
    # nearly all rows are neighbours: those that are not are fewer
    most = n_lib - k
    found = cut(tiles(pred, _farthest(dims, most, radius), "p long, n long, total double, d array<double>, gap array<long>, l array<long>"), "farthest")
    sums = found.groupBy("p").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("out", F.greatest(F.col("n") - k, F.lit(0)))
    each = found.select("p", F.explode(F.arrays_zip("d", "gap", "l")).alias("x")).select("p", "x.*")
    ordered = each.withColumn("turn", F.row_number().over(W.partitionBy("p").orderBy(F.desc("d"), F.desc("gap"), F.desc("l")))).where(F.col("turn") <= most + 1)
    joined = sums.join(ordered, "p", "left")
    gone = F.col("turn") <= F.col("out")
    first = F.min(F.when(gone, F.struct("d", "gap", "l"))).alias("x")
    ended = joined.groupBy("p").agg(F.first("n").alias("n"), F.first("total").alias("total"), F.first("out").alias("out"), F.coalesce(F.sum(F.when(gone, F.col("d"))), F.lit(0.0)).alias("away"), first)
    mean = (F.col("total") - F.col("away")) / F.greatest(F.col("n") - F.col("out"), F.lit(1))
    # the first that is left out bounds the others
    return ended.select("p", mean.alias("mean"), F.coalesce("x.d", F.lit(float("inf"))).alias("d"), F.coalesce(F.col("x.gap") * 1, F.lit(0)).alias("gap"), F.coalesce(F.col("x.l") - 1, F.lit(0)).alias("l"))


def _tile_factors(dims: int, radius: int, thetas: list[float]):
    schema = pa.schema([("p", pa.int64()), ("theta", pa.float64()), ("n", pa.int64()), ("f", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, l_rows, b, y = [], _of(right, "l"), _states(right, "b", dims), _numbers(right, "y")
        p_rows, a, mean, far, apart, last = (_of(left, "p"), _states(left, "a", dims), *[_of(left, c) for c in ("mean", "far", "gap", "last")])
        step = max(1, CELLS // max(1, len(b) * (dims + 2)))
        for at in range(0, len(a), step):
            here = slice(at, at + step)
            d, gap = eligible(p_rows[here], a[here], l_rows, b, radius)
            f, g, r = far[here, None], apart[here, None], last[here, None]
            used = (d < np.inf) & ((d < f) | ((d == f) & ((gap < g) | ((gap == g) & (l_rows <= r)))))
            for theta in thetas:
                whole, spread, n = map_factors(d, used, b, y, mean[here], theta)
                packed = [w.tobytes() + s.tobytes() for w, s in zip(whole, spread, strict=True)]
                out.append(pa.Table.from_arrays([pa.array(p_rows[here]), pa.array(np.full(len(d), theta)), pa.array(n.astype(np.int64)), pa.array(packed, pa.binary())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _unpacked(f: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Stacked factors of one map."""
    c = dims + 2
    flat = np.stack([np.frombuffer(x, np.float64) for x in f])
    return flat[:, : c * c].reshape(-1, c), flat[:, c * c :].reshape(-1, 2)


def _joined_factors(dims: int):
    """Rows (.., f array) with the factor of their factors."""

    def run(batches):
        for b in batches:
            both = [_unpacked(x.as_py(), dims) for x in b.column("f")]
            packed = [triangles(w[None])[0].tobytes() + triangles(s[None])[0].tobytes() for w, s in both]
            at = b.schema.get_field_index("f")
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return run


def _solved(dims: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c, flat = dims + 2, np.stack([np.frombuffer(x.as_py(), np.float64) for x in b.column("f")])
            a = np.column_stack([np.asarray(b.column(f"a{j}")) for j in range(dims)])
            yield _told(_of(b, "p"), _of(b, "theta"), *solved_maps(a, flat[:, : c * c].reshape(-1, c, c), flat[:, c * c :].reshape(-1, 2, 2), _of(b, "n")))

    return run


def local_maps(state: State, thetas: Sequence[float], knn: int, exclusionRadius: int, tile: int = TILE) -> DataFrame:
    """(p, theta, pred, var, c, s): all thetas from one search for neighbours.

    Predicted and library rows meet in tiles. A library of one tile is solved there. A longer one is searched first for the last neighbour of each predicted
    row; then every tile leaves a small triangular factor of its weighted rows for each map, factors meet in a tree of fixed fan-in, and the
    last one has the map's solution and singular values. No task holds more of the library than a tile.
    """
    spark, thetas = state.series.df.sparkSession, [float(t) for t in thetas]
    n_pred, n_lib, dims = state.indices.n_pred, state.indices.n_lib, state.dims
    k = default_knn(state, knn)
    across = max(1, -(-n_lib // tile))
    # as many chunks of predicted rows as keep executors busy
    down = max(-(-n_pred // tile), min(-(-n_pred * min(n_lib, tile) // WORK), 4 * spark.sparkContext.defaultParallelism, n_pred), 1)
    chunk = lambda c, of: F.pmod(F.col(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    pred, lib = state.pred(), state.lib()
    right = lib.select(every(down).alias("_down"), chunk("l", across).alias("_across"), *lib.columns)

    def tiles(left: DataFrame, kernel, schema: str, key: str = "") -> DataFrame:
        dealt = left.select(chunk("p", down).alias("_down"), every(across).alias("_across"), *left.columns)
        at = ["_down", "_across"]
        return dealt.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(kernel, schema)

    if across == 1:
        return tiles(pred, _whole(dims, k, exclusionRadius, thetas), _MAPS)
    bounds = _bounds(pred, lib, dims, k, exclusionRadius, n_pred, n_lib, tiles)
    asked = cut(pred.join(bounds.select("p", "mean", F.col("d").alias("far"), "gap", F.col("l").alias("last")), "p"), "asked")
    factors = tiles(asked, _tile_factors(dims, exclusionRadius, thetas), "p long, theta double, n long, f binary").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(across)))
    while True:
        across = -(-across // FAN_IN)
        met = factors.groupBy("p", "theta", F.pmod("part", F.lit(across)).alias("part")).agg(F.sum("n").alias("n"), F.collect_list("f").alias("f"))
        factors = met.select("p", "theta", "part", "n", "f").mapInArrow(_joined_factors(dims), "p long, theta double, part long, n long, f binary")
        if across == 1:
            break
    whole = factors.join(pred, "p").select("p", "theta", "n", "f", *[f"a{j}" for j in range(dims)]).mapInArrow(_solved(dims), _MAPS)
    # rows without any neighbour have no bounds
    alone = pred.join(asked.select("p"), "p", "left_anti").select("p", F.explode(F.array(*[F.lit(t) for t in thetas])).alias("theta"), *[F.lit(None).cast("double").alias(c) for c in ("pred", "var")], *[F.array_repeat(F.lit(None).cast("double"), dims + 1).alias(c) for c in ("c", "s")])
    return whole.union(alone)


@without_local
def smap(dataFrame: DataFrame | None = None, columns: str | Sequence[str] = "", target: str | Sequence[str] = "", lib="", pred="", E: int = 0, Tp: int = 1, knn: int = 0, tau: int = -1, theta: float = 0, exclusionRadius: int = 0, embedded: bool = False, validLib: Column | Sequence[bool] | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, includeState: bool = False, spark=None) -> Result:
    """predictions (time, Observations, Predictions, Pred_Variance), coefficients and singularValues (Time, C0 ..) of a forecast.

    Arguments are those of simplex, and ``theta``, by which weights exp(-theta d / mean d) fall; 0 gives one linear map. Neighbours
    without a future take no part in a map. Several columns must be ``embedded``.
    """
    given = {k: v for k, v in locals().items() if k not in ("dataFrame", "spark", "pathIn", "dataFile", "pathOut", "predictFile", "parameterList", "includeState")}
    state = prepare("smap", spark, dataFrame, columns, target, lib, pred, E, Tp, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile)
    if not embedded and state.dims != E:
        raise ValueError("smap: several columns are a state only if they are embedded")
    # three frames read them
    maps = cut(local_maps(state, [theta], knn, exclusionRadius), "maps")
    laid = layout(state.series, state.target, maps, state.indices, Tp, keep_row=True)
    if predictFile:
        write_csv(laid.orderBy("segment", ROW).drop("segment", ROW), pathOut, predictFile)
    # coefficients stand where their prediction does
    place = laid.select("segment", ROW, F.col(laid.columns[2]).alias("Time"))
    found = maps.select((F.col("p") + Tp).alias(ROW), "c", "s")
    both = place.join(found, ROW, "left").orderBy("segment", ROW)
    coefficients = both.select("Time", *[F.col("c")[j].alias("C0" if not j else f"∂{state.target}/∂{state.names[j - 1]}") for j in range(state.dims + 1)])
    singular = both.select("Time", *[F.col("s")[j].alias(f"C{j}") for j in range(state.dims + 1)])
    near = neighbors(state.pred(), state.lib(), state.dims, default_knn(state, knn), exclusionRadius, state.indices.n_pred, state.indices.n_lib) if includeState else None
    return Result(laid.drop("segment", ROW), coefficients, singular, given if parameterList else None, state_frames(state, near) if includeState else {})
