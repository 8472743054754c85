"""Where observations and predictions of a forecast stand in its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.index import Indices
from ..sources.series import ROW, Series, quoted


def slots(indices: Indices, Tp: int, n: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(segment, first row, last row, first and last observed row, first and last predicted row p) of each segment."""
    out = []
    for s, (a, b) in enumerate(indices.pred):
        if Tp > 0:
            out.append((s, a, b + Tp, a, b + Tp if b + Tp <= n else b, a, b))
        elif Tp < 0:
            out.append((s, a + Tp, b, max(1, a + Tp), b, a, b))
        else:
            out.append((s, a, b, a, b, a, b))
    return out


def time_of(series: Series, beyond: bool = True) -> Column:
    """The row's time; numeric ones go on beyond both ends with the step of the first two rows, others are null there."""
    if not beyond or not isinstance(series.time_type, T.NumericType):
        return quoted(series.time)
    kind = series.time_type.simpleString()
    ends = {r[ROW]: r[series.time] for r in series.df.where(F.col(ROW).isin(1, 2, series.n)).select(ROW, quoted(series.time)).collect()}
    first, last = ends.get(1), ends.get(series.n)
    step = (ends[2] - first) if series.n > 1 and ends.get(2) is not None and first is not None else 0
    after = F.when((F.col(ROW) > series.n) & F.lit(last is not None), F.lit(last or 0) + step * (F.col(ROW) - series.n))
    before = F.when((F.col(ROW) < 1) & F.lit(first is not None), F.lit(first or 0) + step * (F.col(ROW) - 1))
    return F.coalesce(quoted(series.time), after.cast(kind), before.cast(kind)).alias(series.time)


def layout(series: Series, target: str, predictions: DataFrame, indices: Indices, Tp: int, keep_row: bool = False) -> DataFrame:
    """(time, Observations, Predictions, Pred_Variance) in order; ``predictions`` has p, pred, var, and its value stands at p + Tp."""
    spark = series.df.sparkSession
    table = slots(indices, Tp, series.n) or [(0, 1, 0, 1, 0, 1, 0)]
    frame = spark.createDataFrame(table, "segment int, lo long, hi long, olo long, ohi long, plo long, phi long").where("lo <= hi")
    rows = frame.select("segment", "olo", "ohi", "plo", "phi", F.explode(F.sequence("lo", "hi")).alias(ROW))
    data = series.df.select(ROW, quoted(series.time), quoted(target).alias("_obs")) if target != series.time else series.df.select(ROW, quoted(series.time), quoted(series.time).cast("double").alias("_obs"))
    placed = rows.join(data, ROW, "left").join(predictions.select((F.col("p") + Tp).alias(ROW), F.col("pred").alias("_pred"), F.col("var").alias("_var")), ROW, "left")
    own = (F.col(ROW) - Tp).between(F.col("plo"), F.col("phi"))
    out = placed.select(
        "segment",
        ROW,
        time_of(series, any(lo < 1 or hi > series.n for _, lo, hi, *_ in table)),
        F.when(F.col(ROW).between(F.col("olo"), F.col("ohi")), F.col("_obs")).alias("Observations"),
        F.when(own, F.col("_pred")).alias("Predictions"),
        F.when(own, F.col("_var")).alias("Pred_Variance"),
    ).orderBy("segment", ROW)
    return out if keep_row else out.drop("segment", ROW)
