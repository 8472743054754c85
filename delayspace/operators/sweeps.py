"""Parameter sweeps. A swept value is one more key of a single plan, not a run of its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.args import without_local
from ..functions.stats import compute_error
from ..plans.index import within
from ..sources.series import ROW, quoted, write_csv
from .layout import slots
from .neighbors import BROADCAST, View, neighbors, ranked_neighbors, view_neighbors
from .simplex import project
from .smap import local_maps
from .state import Result, State, prepare

# The radii and thetas of a sweep that names none.
RADII = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 25, 30)
THETAS = (0.01, 0.1, 0.3, 0.5, 0.75, 1, 1.5, 2, 3, 4, 5, 6, 7, 8, 9)


def placed(state: State) -> Column:
    """Whether the layout of a forecast has both an observation and a prediction at a row."""
    on = F.lit(False)
    for _, _, _, olo, ohi, plo, phi in slots(state.indices, state.Tp, state.series.n):
        on = on | ((F.col(ROW) - state.Tp).between(plo, phi) & F.col(ROW).between(olo, ohi))
    return on


def observed(state: State, projected: DataFrame, keys: Sequence[str], on: Column | None = None, ahead: Column | None = None) -> DataFrame:
    """(keys, Observations, Predictions) where the layout has both."""
    seen = state.series.df.select(ROW, quoted(state.target).alias("Observations"))
    at = (F.col("p") + (F.lit(state.Tp) if ahead is None else ahead)).alias(ROW)
    rows = projected.select(*keys, at, F.col("pred").alias("Predictions")).where(placed(state) if on is None else on)
    return rows.join(seen, ROW).select(*keys, "Observations", "Predictions")


def _rho(parts: list[DataFrame], key: str, kind: str) -> DataFrame:
    both = reduce(DataFrame.unionByName, parts)
    return compute_error(both, by=[key]).select(F.col(key).cast(kind).alias(key), "rho").orderBy(key)


def _finish(given: dict, pathOut: str, predictFile: str, parameterList: bool):
    """What a sweep does with its table: writes it if a file is named, and gives it with the call's parameters if asked."""
    parameters = {k: v for k, v in given.items() if k not in ("dataFrame", "spark", "pathIn", "dataFile", "pathOut", "predictFile", "parameterList")}

    def run(table: DataFrame) -> DataFrame | Result:
        if predictFile:
            write_csv(table, pathOut, predictFile, table.columns[:1])
        return Result(table, parameters=parameters) if parameterList else table

    return run


def _args(dataFrame, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark):
    return lambda name, E, Tp: prepare(name, spark, dataFrame, columns, target, lib, pred, E, Tp, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile)


@without_local
def embed_dimension(dataFrame: DataFrame | None = None, columns="", target="", lib="", pred="", maxE: int = 10, Tp: int = 1, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib: Column | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> DataFrame | Result:
    """(E, rho): Simplex skill for E = 1 .. maxE, each with E + 1 neighbours."""
    finish = _finish(locals(), pathOut, predictFile, parameterList)
    at = _args(dataFrame, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)
    widest = at("embed_dimension", maxE, Tp)
    again = _args(widest.series, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)
    states = [again("embed_dimension", E, Tp) for E in range(1, maxE)] + [widest]
    if embedded:  # the state is one whatever E
        parts = []
        for E, s in enumerate(states, 1):
            near = neighbors(s.pred(), s.lib(), s.dims, s.E + 1, exclusionRadius, s.indices.n_pred, s.indices.n_lib, carry=["y"])
            parts.append(observed(s, project(near), []).withColumn("E", F.lit(E)))
        return finish(_rho(parts, "E", "int"))
    # the lags of a smaller E are among those of the largest: each is a view of it, and all are searched in one pass
    n, row = widest.dims // maxE, F.col(ROW)
    views = [View(s.E, [c * maxE + k for c in range(n) for k in range(s.E)], s.E + 1, s.indices.pred, s.indices.lib) for s in states]
    some = lambda part: reduce(lambda x, y: x | y, [within(getattr(s.indices, part), row) for s in states])
    left = widest.vectors.where(some("pred")).select(row.alias("p"), *[F.col(f"v{j}").alias(f"a{j}") for j in range(widest.dims)])
    lib_rows = widest.vectors.where(some("lib"))
    if widest.valid is not None:
        lib_rows = lib_rows.join(widest.valid, ROW, "left_semi")
    right = lib_rows.select(row.alias("l"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(widest.dims)], F.col("y").alias("y"))
    most = lambda part: max(getattr(s.indices, part) for s in states)
    near = view_neighbors(left, right, widest.dims, views, exclusionRadius, most("n_pred"), most("n_lib")).withColumnRenamed("view", "E")
    on = reduce(lambda x, y: x | y, [(F.col("E") == s.E) & placed(s) for s in states])
    return finish(_rho([observed(widest, project(near, ["E"]), ["E"], on)], "E", "int"))


@without_local
def predict_interval(dataFrame: DataFrame | None = None, columns="", target="", lib="", pred="", maxTp: int = 10, E: int = 1, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib: Column | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> DataFrame | Result:
    """(Tp, rho): Simplex skill for Tp = 1 .. maxTp; the library ends earlier for each."""
    finish = _finish(locals(), pathOut, predictFile, parameterList)
    at = _args(dataFrame, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)
    first = at("predict_interval", E, 1)
    again = _args(first.series, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)
    states = [first] + [again("predict_interval", E, Tp) for Tp in range(2, maxTp + 1)]
    # a library for a larger Tp lacks the last rows of that for the first, of which there are Tp - 1: so many more neighbours hold the k of every Tp
    s, k = states[0], states[0].E + 1
    near = neighbors(s.pred(), s.lib(), s.dims, k + maxTp - 1, exclusionRadius, s.indices.n_pred, s.indices.n_lib)
    each = [F.when(within(t.indices.pred, F.col("p")) & within(t.indices.lib, F.col("l")), F.lit(t.Tp)) for t in states]
    seen = near.select("p", "l", "d", F.explode(F.array_compact(F.array(*each))).alias("Tp"))
    near = ranked_neighbors(seen, k, ["Tp"])
    future = s.series.df.select(F.col(ROW).alias("_at"), quoted(s.target).alias("y"))
    near = near.join(F.broadcast(future) if s.series.n <= BROADCAST else future, F.col("_at") == F.col("l") + F.col("Tp"), "left").drop("_at")
    on = reduce(lambda x, y: x | y, [(F.col("Tp") == t.Tp) & placed(t) for t in states])
    return finish(_rho([observed(s, project(near, ["Tp"]), ["Tp"], on, F.col("Tp"))], "Tp", "int"))


@without_local
def predict_exclusion_radius(dataFrame: DataFrame | None = None, columns="", target="", lib="", pred="", exclusionRadius: Sequence[int] | None = None, E: int = 1, Tp: int = 1, tau: int = -1, embedded: bool = False, validLib: Column | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> DataFrame | Result:
    """(ExclusionRadius, rho): Simplex skill by the radius. Distances are worked out once for all radii."""
    finish = _finish(locals(), pathOut, predictFile, parameterList)
    s = _args(dataFrame, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)("predict_exclusion_radius", E, Tp)
    spark = s.series.df.sparkSession
    radii = spark.createDataFrame([(int(r),) for r in exclusionRadius or RADII], "ExclusionRadius int")
    k, widest = s.E + 1, max(exclusionRadius or RADII)
    # of all pairs a radius of r leaves at most 2r + 1 rows out, so k + 2r + 1 neighbours hold the k of every radius
    most = neighbors(s.pred(), s.lib(), s.dims, k + 2 * widest + 1, -1, s.indices.n_pred, s.indices.n_lib, carry=["y"])
    near = most.drop("rank").join(F.broadcast(radii), F.abs(F.col("p") - F.col("l")) > F.col("ExclusionRadius"))
    projected = project(ranked_neighbors(near, k, ["ExclusionRadius"]), ["ExclusionRadius"])
    return finish(_rho([observed(s, projected, ["ExclusionRadius"])], "ExclusionRadius", "int"))


@without_local
def predict_nonlinear(dataFrame: DataFrame | None = None, columns="", target="", lib="", pred="", theta: Sequence[float] | None = None, E: int = 1, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib: Column | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> DataFrame | Result:
    """(Theta, rho): S-map skill by theta, all from one search for neighbours."""
    finish = _finish(locals(), pathOut, predictFile, parameterList)
    s = _args(dataFrame, columns, target, lib, pred, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile, spark)("predict_nonlinear", E, Tp)
    maps = local_maps(s, theta or THETAS, knn, exclusionRadius).withColumnRenamed("theta", "Theta")
    return finish(_rho([observed(s, maps, ["Theta"])], "Theta", "double"))


__all__ = ["embed_dimension", "predict_interval", "predict_exclusion_radius", "predict_nonlinear", "RADII", "THETAS"]
