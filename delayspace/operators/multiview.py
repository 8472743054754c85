"""Multiview: the mean forecast of the best low-dimensional views of a system."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.args import split_columns, without_local
from ..functions.stats import compute_error
from ..plans.index import Indices, create_indices, within
from ..sources.series import ROW, Series, load, quoted, resolve_input, shifted, valid_frame, write_csv
from .embed import check_embedding, lag_columns, lag_names
from .layout import layout
from .neighbors import View, view_neighbors
from .simplex import project

#: Rows of a tile's side.
TILE = 4_096


@dataclass
class Views:
    """Predictions (time, Observations, Predictions) and View (Columns, rho, MAE, CAE, RMSE)."""

    Predictions: DataFrame
    View: DataFrame
    parameters: dict | None = None


def all_views(names: Sequence[str], D: int) -> list[tuple[int, tuple[int, ...], str]]:
    """(view_id, places of its columns, Columns): every D of the columns, in lexicographic order of their places."""
    return [(i, c, "(" + ", ".join(f"'{names[j]}'" for j in c) + ")") for i, c in enumerate(combinations(range(len(names)), D))]


def view_projections(vectors: DataFrame, dims: int, views: Sequence[tuple[int, tuple[int, ...], str]], indices: Indices, pred: list[tuple[int, int]], k: int, radius: int, tile: int = TILE) -> DataFrame:
    """(view_id, p, pred, var) of all views: tiles of predicted and library rows hand on k neighbours of each row and view, and no pairs."""
    row = F.col(ROW)
    left = vectors.where(within(pred, row)).select(row.alias("p"), *[F.col(f"v{j}").alias(f"a{j}") for j in range(dims)])
    right = vectors.where(within(indices.lib, row)).select(row.alias("l"), *[F.col(f"v{j}").alias(f"b{j}") for j in range(dims)], F.col("y").alias("y"))
    asked = [View(i, places, k) for i, places, _ in views]
    near = view_neighbors(left, right, dims, asked, radius, sum(b - a + 1 for a, b in pred), indices.n_lib, tile).withColumnRenamed("view", "view_id")
    return project(near, ["view_id"])


def skill(series: Series, target: str, projected: DataFrame, pred: list[tuple[int, int]], Tp: int, n: int) -> DataFrame:
    """Errors by view, over the rows of the layout that have an observation."""
    lo_hi = [(a + max(Tp, 0), b + Tp if b + Tp <= n else b) for a, b in pred]
    seen = series.df.select(ROW, quoted(target).alias("Observations")).where(within(lo_hi, F.col(ROW)))
    both = projected.select("view_id", (F.col("p") + Tp).alias(ROW), F.col("pred").alias("Predictions")).join(seen, ROW)
    return compute_error(both, by=["view_id"])


@without_local
def multiview(dataFrame: DataFrame | None = None, columns: str | Sequence[str] = "", target: str | Sequence[str] = "", lib="", pred="", D: int = 0, E: int = 1, Tp: int = 1, knn: int = 0, tau: int = -1, multiview: int = 0, exclusionRadius: int = 0, trainLib: bool = True, excludeTarget: bool = False, ignoreNan: bool = True, noTime: bool = False, pathIn: str = "./", dataFile: str = "", pathOut: str = "./", predictFile: str = "", parameterList: bool = False, spark=None) -> Views:
    """Ranks all D-column views of the embedding by their skill, in the library (trainLib) or on the predicted rows, and averages the best.

    D is the number of columns by default, and floor(sqrt(views)) views are averaged. Views without a skill rank last, ties by their
    order. A row whose forecast some view lacks has none. ``excludeTarget`` keeps the target's own lags out of the views.
    """
    given = {k: v for k, v in locals().items() if k not in ("dataFrame", "spark", "pathIn", "dataFile", "pathOut", "predictFile", "parameterList")}
    df, order = (dataFrame.df.drop(ROW), None) if isinstance(dataFrame, Series) else resolve_input(spark, dataFrame, dataFile, pathIn)
    spark = df.sparkSession
    cols, tgt = split_columns(columns), split_columns(target)[0]
    if not isinstance(dataFrame, Series):
        valid_frame(df, cols, [tgt], noTime)
    check_embedding(df.columns, cols, E, tau, "multiview")
    series = dataFrame if isinstance(dataFrame, Series) else load(df, noTime, order, keep=[*cols, tgt])
    if not lib and not pred and trainLib:
        lib, pred = (1, series.n // 2), (series.n // 2 + 1, series.n)
    used = [c for c in cols if not (excludeTarget and c == tgt)]
    D = D or len(cols)
    names = lag_names(used, E, tau)
    if D > len(names):
        raise ValueError(f"multiview: views of {D} columns, and the embedding has {len(names)}")
    # views are embedded columns: a row takes part in those whose lags it has
    indices = create_indices(lib, pred, E, tau, Tp, True, series.n, "multiview")
    ranked_on = indices.lib if trainLib else indices.pred
    wanted = lag_columns(used, E, tau, [f"v{j}" for j in range(len(names))])
    v = shifted(series.df, series.n, wanted | {"y": (tgt, Tp)})
    ok = F.lit(True)
    for name in wanted:
        ok = ok & F.col(name).isNotNull()
    if not ignoreNan and not v.where((within(indices.lib, F.col(ROW)) | within(indices.pred, F.col(ROW))) & ~ok).isEmpty():
        raise ValueError("multiview: vectors with missing values, and ignoreNan is off")
    vectors = v.select(ROW, *wanted, "y", ok.alias("ok"))
    views, k = all_views(names, D), knn or D + 1
    keep = min(multiview or max(1, math.isqrt(len(views))), len(views))
    ranking = skill(series, tgt, view_projections(vectors, len(names), views, indices, ranked_on, k, exclusionRadius), ranked_on, Tp, series.n)
    # one skill for each view; there are as many as the caller asks for
    rho = {r["view_id"]: r["rho"] for r in ranking.select("view_id", "rho").collect()}
    best = sorted(views, key=lambda v: (rho.get(v[0]) is None, -(rho.get(v[0]) or 0.0), v[0]))[:keep]
    chosen = spark.createDataFrame([(v[0], place, v[2]) for place, v in enumerate(best)], "view_id int, _rank int, Columns string")
    projected = view_projections(vectors, len(names), best, indices, indices.pred, k, exclusionRadius)
    mean = projected.groupBy("p").agg(F.when(F.count("pred") == keep, F.avg("pred")).alias("pred"), F.lit(None).cast("double").alias("var"))
    out = layout(series, tgt, mean, indices, Tp).drop("Pred_Variance")
    errors = skill(series, tgt, projected, indices.pred, Tp, series.n).drop("MAE_true")
    table = chosen.join(errors, "view_id", "left").orderBy("_rank").drop("view_id", "_rank")
    if predictFile:
        write_csv(out, pathOut, predictFile)
    return Views(out, table, given if parameterList else None)
