"""Simplex projection: the weighted mean of the neighbours' future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.args import without_local
from ..sources.series import ROW, clean, number_panel, shifted, write_csv
from .layout import layout
from .neighbors import neighbors
from .state import Result, State, prepare, state_frames

FLOOR = 1e-6


def project(near: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, p, pred, var) of neighbours (keys, p, l, d, y), all within the partitioning that ranked them.

    Weights are exp(-d / least d), the least being 1e-6 at least. A neighbour without a future leaves both null.
    """
    w = W.partitionBy(*keys, "p")
    weighed = near.withColumn("w", F.exp(-F.col("d") / F.greatest(F.min("d").over(w), F.lit(FLOOR))))
    mean = F.sum(F.col("w") * F.col("y")).over(w) / F.sum("w").over(w)
    centred = weighed.withColumn("m", mean)
    whole = F.count("y") == F.count("l")
    return centred.groupBy(*keys, "p").agg(
        F.when(whole, F.first("m")).alias("pred"),
        F.when(whole, F.sum(F.col("w") * (F.col("y") - F.col("m")) * (F.col("y") - F.col("m"))) / F.sum("w")).alias("var"),
    )


def simplex_neighbors(state: State, knn: int, exclusionRadius: int) -> DataFrame:
    return neighbors(state.pred(), state.lib(), state.dims, knn or state.E + 1, exclusionRadius, state.indices.n_pred, state.indices.n_lib, carry=["y"])


@without_local
def simplex(dataFrame: DataFrame | None = None, columns: str | Sequence[str] = "", target: str | Sequence[str] = "", lib="", pred="", E: int = 0, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0, embedded: bool = False, validLib: Column | Sequence[bool] | None = None, noTime: bool = False, ignoreNan: bool = True, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, includeState: bool = False, spark=None) -> DataFrame | Result:
    """A forecast (time, Observations, Predictions, Pred_Variance) of ``target`` Tp rows on, from states of ``columns``.

    Row ranges ``lib`` and ``pred`` count from 1 and include both ends; several may be given. ``embedded`` columns are the state as
    they are, otherwise E lags of each. knn is E + 1 by default. With ``parameterList`` or ``includeState`` a :class:`Result`.
    """
    given = {k: v for k, v in locals().items() if k not in ("dataFrame", "spark", "pathIn", "dataFile", "pathOut", "predictFile", "parameterList", "includeState")}
    state = prepare("simplex", spark, dataFrame, columns, target, lib, pred, E, Tp, tau, embedded, validLib, noTime, ignoreNan, pathIn, dataFile)
    near = simplex_neighbors(state, knn, exclusionRadius)
    out = layout(state.series, state.target, project(near), state.indices, Tp)
    if predictFile:
        write_csv(layout(state.series, state.target, project(near), state.indices, Tp, keep_row=True).orderBy("segment", ROW).drop("segment", ROW), pathOut, predictFile)
    if not parameterList and not includeState:
        return out
    return Result(out, parameters=given if parameterList else None, state=state_frames(state, near) if includeState else {})


def panel_simplex(df: DataFrame, by: Sequence[str], order: str, column: str, target: str, lib: tuple[int, int] | None, pred: tuple[int, int] | None, E: int, Tp: int = 1, knn: int = 0, tau: int = -1, exclusionRadius: int = 0) -> DataFrame:
    """Simplex for every series of a panel at once: (by, row_id, Observations, Predictions, Pred_Variance), rows at p + Tp.

    ``by`` names the series, whose rows are numbered by ``order``; ranges hold in each, as far as it goes, and where none is given the
    library is the first half of each series and the second is predicted. The series are an extra
    key of one plan, so a cluster works on all of them side by side.
    """
    named, by = list(by), [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(named, by, strict=True)], F.col(order).alias("_t"), clean(F.col(column)).alias("_x"), clean(F.col(target)).alias("_y"))
    rows = number_panel(rows, by, "_t")
    v = shifted(rows, None, {f"v{j}": ("_x", tau * j) for j in range(E)} | {"y": ("_y", Tp)}, by, keep=["_n"])
    ok = F.lit(True)
    for j in range(E):
        ok = ok & F.col(f"v{j}").isNotNull()
    v = v.where(ok)
    reach = abs(tau) * (E - 1)
    half = F.floor(F.col("_n") / 2)
    start, stop = lib or (1, half)
    asked = [F.lit(x) if isinstance(x, int) else x for x in pred or (half + 1, F.col("_n"))]
    end = F.least(F.lit(stop) if isinstance(stop, int) else stop, F.col("_n")) - max(Tp, 0) - (reach if tau > 0 else 0)
    first = start + (reach if tau < 0 else 0) + (abs(Tp) - 1 if Tp < 0 else 0)
    left = v.where(F.col(ROW).between(*asked)).select(*by, F.col(ROW).alias("p"), *[F.col(f"v{j}").alias(f"a{j}") for j in range(E)], F.col("y").alias("Observations"))
    right = v.where(F.col(ROW).between(F.lit(first), end)).select(*by, F.col(ROW).alias("l"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(E)], "y")
    near = neighbors(left.drop("Observations"), right, E, knn or E + 1, exclusionRadius, keys=by, carry=["y"])
    out = left.select(*by, "p", "Observations").join(project(near, by), [*by, "p"], "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(named, by, strict=True)], (F.col("p") + Tp).alias(ROW), "Observations", F.col("pred").alias("Predictions"), F.col("var").alias("Pred_Variance"))
