"""Convergent cross mapping: skill by library size, in both directions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.args import split_columns, without_local
from ..sources.scratch import cut
from ..sources.series import ROW, Series, load, quoted, resolve_input, valid_frame, write_csv
from .embed import check_embedding
from .neighbors import euclidean, neighbors, ranked_neighbors
from .state import Result, columns_in, valid_rows, vectors_of

#: Longest list of neighbours that is searched for a point; hexadecimal digits of keys by which drawn rows are counted.
PREFIX, DIGITS = 512, 4


def library_sizes(sizes: str | Sequence[int], n_rows: int) -> list[int]:
    """Three sizes whose third is below the second are start, stop and step; others are taken as they are."""
    got = [int(v) for v in (sizes.split() if isinstance(sizes, str) else sizes)]
    if not got:
        raise ValueError("ccm: no library sizes")
    if len(got) == 3 and got[2] < got[1]:
        if got[2] < 1:
            raise ValueError("ccm: the step of library sizes must be 1 or more")
        got = list(range(got[0], got[1] + 1, got[2]))
    if min(got) < 1 or got[-1] > n_rows:
        raise ValueError(f"ccm: library sizes must be within 1 and the {n_rows} rows")
    return got


def cross_points(series: Series, columns: Sequence[str], target: str, E: int, tau: int, Tp: int, embedded: bool, valid: DataFrame | None) -> DataFrame:
    """row_id, v0.., y of the rows that can be asked for and be in a library: whole vectors that have a future."""
    v = vectors_of(series, columns, target, E, tau, Tp, embedded).where("ok AND y IS NOT NULL")
    if valid is not None:
        v = v.join(valid, ROW, "left_semi")
    own = series.df.where(quoted(columns[0]).isNotNull()).select(ROW)
    return v.join(own, ROW, "left_semi").drop("ok")


def drawn_rows(points: DataFrame, tasks: DataFrame, seed: int, direction: str) -> DataFrame:
    """(task, row_id): for each of ``tasks`` (task, lib_size, trial, L) the L rows with the smallest MD5 of (seed, direction, size, trial, row).

    Rows are counted by the first digits of their key, which tells all but those that share the digits of the last one drawn; only these are
    put in order.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(direction), F.col("lib_size").cast("string"), F.col("trial").cast("string"), F.col(ROW).cast("string")).cast("binary"))
    # the number of tasks is the caller's
    keyed = points.select(ROW).join(F.broadcast(tasks), F.lit(True)).select("task", "L", ROW, key.alias("key")).withColumn("first", F.substring("key", 1, DIGITS))
    counts = keyed.groupBy("task", "L", "first").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("task").orderBy("first")))
    last = F.broadcast(upto.where("upto >= L AND upto - n < L").select("task", F.col("first").alias("last"), (F.col("L") - F.col("upto") + F.col("n")).alias("room")))
    met = keyed.join(last, "task").where("first <= last")
    sure = met.where("first < last").select("task", ROW)
    turn = F.row_number().over(W.partitionBy("task").orderBy("key", ROW))
    return sure.union(met.where("first = last").withColumn("turn", turn).where("turn <= room").select("task", ROW))


def _masks(n_tasks: int):
    """Lists of task numbers as bits."""
    schema = pa.schema([(ROW, pa.int64()), ("mask", pa.binary())])

    def run(batches):
        for b in batches:
            bits = np.zeros((b.num_rows, n_tasks), np.uint8)
            tasks = b.column("tasks")
            bits[np.repeat(np.arange(b.num_rows), np.diff(np.asarray(tasks.offsets))), np.asarray(tasks.flatten())] = 1
            yield pa.RecordBatch.from_arrays([b.column(ROW), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], schema=schema)

    return run


def estimates(d: np.ndarray, y: np.ndarray, member: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, number of neighbours found) of each task, from a point's neighbours in order and the tasks (columns of ``member``) whose library they are in.

    The first k members weigh exp(-d / least d); beside one at distance 0, only such count.
    """
    place = np.cumsum(member, axis=0)
    use = member & (place <= k)
    first = np.where(use, d[:, None], np.inf).min(axis=0, initial=np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.where(first > 0, np.exp(-d[:, None] / np.where(first > 0, first, 1)), (d[:, None] == 0).astype(float)) * use
        return (w * y[:, None]).sum(axis=0) / w.sum(axis=0), use.sum(axis=0)


def _points(tasks: list[tuple[int, int]], n_tasks: int, whole: int):
    """(task, p, o, q) from (p, o, near): estimates q of those of ``tasks`` (number, k) that find their k; q is null where a list of ``whole`` rows ran out before."""
    number, k = np.array([t for t, _ in tasks]), np.array([n for _, n in tasks])
    schema = pa.schema([("task", pa.int32()), ("p", pa.int64()), ("o", pa.float64()), ("q", pa.float64())])

    def run(batches):
        for b in batches:
            out = []
            for p, o, near in zip(b.column("p").to_pylist(), b.column("o").to_pylist(), b.column("near"), strict=True):
                x = near.values
                bits = np.frombuffer(b"".join(x.field("mask").to_pylist()), np.uint8).reshape(len(x), -1)
                member = np.unpackbits(bits, axis=1, count=n_tasks).astype(bool)[:, number]
                q, found = estimates(np.asarray(x.field("d")), np.asarray(x.field("y")), member, k)
                full = found == k
                said = full | (len(x) >= whole)
                out.append((number[said], np.full(said.sum(), p), np.full(said.sum(), o), np.where(full, q, np.nan)[said]))
            if out:
                task, p, o, q = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(p), pa.array(o), pa.array(q, from_pandas=True)], schema=schema)

    return run


def direction_trials(points: DataFrame, dims: int, m: int, sizes: Sequence[int], trials: int, most: int, seed: int, direction: str, k: int, radius: int) -> DataFrame:
    """(direction, lib_size, trial, rho) of one direction with ``m`` points: ``trials`` of each size below ``most``, one of the others.

    Neighbours are searched once: every point gets a list long enough for k members of all but the smallest libraries, which each row of
    the list names by bits. Points whose list runs out, and libraries too small for it, are searched by themselves.
    """
    spark = points.sparkSession
    tasks = [(i, int(s), t, min(int(s), m), min(k, min(int(s), m) - 1)) for i, (s, t) in enumerate((s, t) for s in sizes for t in range(trials if s < most else 1))]
    schema = "task int, lib_size long, trial long, L long, k int"
    table = spark.createDataFrame(tasks, schema)
    part = [t for t in tasks if t[3] < m]
    always = F.array(*[F.lit(t[0]) for t in tasks if t[3] >= m]).cast("array<int>")
    libraries = points.select(ROW, always.alias("tasks"))
    if part:
        members = cut(drawn_rows(points, spark.createDataFrame(part, schema), seed, direction), "drawn")
        by_row = members.groupBy(ROW).agg(F.collect_list("task").alias("tasks"))
        libraries = points.select(ROW).join(by_row, ROW, "left").select(ROW, F.concat(F.coalesce("tasks", F.array().cast("array<int>")), always).alias("tasks")).where("size(tasks) > 0")
    masked = points.join(libraries.mapInArrow(_masks(len(tasks)), f"{ROW} long, mask binary"), ROW)
    left = points.select(F.col(ROW).alias("p"), *[F.col(f"v{j}").alias(f"a{j}") for j in range(dims)])
    right = masked.select(F.col(ROW).alias("l"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(dims)], "y", "mask")
    # a member is met every m / L rows of a list, and every row is one of a library of all
    spaced = {t[0]: t[4] if t[3] >= m else -(-4 * t[4] * m // t[3]) for t in tasks if t[4] > 0}
    listed = [t for t in tasks if t[0] in spaced and (spaced[t[0]] <= PREFIX or m <= PREFIX or t[3] >= m)]
    direct = [t for t in tasks if t[0] in spaced and t not in listed]
    found = spark.createDataFrame([], "task int, p long, o double, q double")
    if listed:
        length = min(m, max(spaced[t[0]] for t in listed))
        near = neighbors(left, right, dims, length, radius, m, m, carry=["y", "mask"])
        lists = near.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "y", "mask"))).alias("near"))
        seen = lists.join(points.select(F.col(ROW).alias("p"), F.col("y").alias("o")), "p").select("p", "o", "near")
        found = seen.mapInArrow(_points([(t[0], t[4]) for t in listed], len(tasks), length), "task int, p long, o double, q double")
        found = cut(found, "found") if part else found
    # a library of all rows never runs out before k
    asked = found.where("q IS NULL").select("task", "p")
    if direct:
        asked = asked.union(points.select(F.explode(F.array(*[F.lit(t[0]) for t in direct])).alias("task"), F.col(ROW).alias("p")))
    if part and (direct or not asked.isEmpty()):
        every = members.select("task", F.col(ROW).alias("l"))
        pairs = asked.join(left, "p").join(every, "task").where(F.abs(F.col("p") - F.col("l")) > radius).join(right.drop("mask"), "l").withColumn("d", euclidean(dims))
        best = ranked_neighbors(pairs.join(F.broadcast(table.select("task", "k")), "task"), F.col("k"), ["task"], k)
        first = F.min("d").over(W.partitionBy("task", "p"))
        weighed = best.withColumn("first", first).withColumn("w", F.when(F.col("first") > 0, F.exp(-F.col("d") / F.col("first"))).otherwise((F.col("d") == 0).cast("double")))
        alone = weighed.groupBy("task", "p", "k").agg(F.count("*").alias("n"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("q")).where("n = k")
        found = found.where("q IS NOT NULL").unionByName(alone.join(points.select(F.col(ROW).alias("p"), F.col("y").alias("o")), "p").select("task", "p", "o", "q"))
    spread = F.stddev_pop("o") * F.stddev_pop("q")
    rho = F.when(F.count("*") >= 3, F.coalesce(F.covar_pop("o", "q") / F.nullif(spread, F.lit(0.0)), F.lit(0.0)))
    skills = found.where("q IS NOT NULL").groupBy("task").agg(rho.alias("rho"))
    return table.join(skills, "task", "left").select(F.lit(direction).alias("direction"), "lib_size", "trial", "rho")


def ccm_trials(points: dict[str, DataFrame], dims: dict[str, int], sizes: Sequence[int], sample: int, seed: int, k: int, radius: int) -> DataFrame:
    """(direction, lib_size, trial, rho) of both directions. A library that is all there is gives the same in every trial."""
    held = {name: cut(df.select(ROW, *[f"v{j}" for j in range(dims[name])], "y"), "points") for name, df in points.items()}
    many = {name: df.count() for name, df in held.items()}
    out = [direction_trials(df, dims[name], many[name], sizes, sample, max(many.values()), seed, name, k, radius) for name, df in held.items()]
    return out[0].union(out[1])


@without_local
def ccm(dataFrame: DataFrame | None = None, columns: str | Sequence[str] = "", target: str | Sequence[str] = "", E: int = 0, Tp: int = 0, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, libSizes: str | Sequence[int] = "", sample: int = 30, seed: int = 0, embedded: bool = False, validLib: Column | Sequence[bool] | None = None, includeData: bool = False, noTime: bool = False, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> DataFrame | Result:
    """(LibSize, ``a:b``, ``b:a``): mean skill with which states of a give b, and of b give a, by library size; ``_var`` columns with includeData.

    Each trial draws its library by hashes of (seed, direction, size, trial, row), so a result depends on nothing else. All points are
    asked for, those with fewer than k eligible neighbours are left out.
    """
    given = {k: v for k, v in locals().items() if k not in ("dataFrame", "spark", "pathIn", "dataFile", "pathOut", "predictFile", "parameterList")}
    df, order = (dataFrame.df.drop(ROW), None) if isinstance(dataFrame, Series) else resolve_input(spark, dataFrame, dataFile, pathIn)
    spark = df.sparkSession
    a, b = split_columns(columns), split_columns(target)
    if not a or not b:
        raise ValueError("ccm: columns and target are needed")
    if not isinstance(dataFrame, Series):
        valid_frame(df, a, b, noTime)
    if embedded:
        E = len(a)
    else:
        check_embedding(df.columns, [*a, *b], E, tau, "ccm")
    series = dataFrame if isinstance(dataFrame, Series) else load(df, noTime, order, keep=[*a, *b, *columns_in(validLib, df)])
    sizes = library_sizes(libSizes, series.n)
    valid = valid_rows(series, validLib)
    names = [f"{a[0]}:{b[0]}", f"{b[0]}:{a[0]}"]
    points = {n: cross_points(series, x, y[0], E, tau, Tp, embedded, valid) for n, x, y in zip(names, (a, b), (b, a), strict=True)}
    dims = {n: len(x) * (1 if embedded else E) for n, x in zip(names, (a, b), strict=True)}
    trials = ccm_trials(points, dims, sizes, sample, seed, knn or E + 1, exclusionRadius)
    cells = trials.groupBy("lib_size").pivot("direction", names).agg(F.avg("rho").alias("mean"), F.var_pop("rho").alias("var"))
    out = cells.select(F.col("lib_size").alias("LibSize"), *[quoted(f"{n}_mean").alias(n) for n in names], *([quoted(f"{n}_var").alias(f"{n}_var") for n in names] if includeData else [])).orderBy("LibSize")
    if predictFile:
        write_csv(out, pathOut, predictFile, ["LibSize"])
    return Result(out, parameters=given) if parameterList else out
