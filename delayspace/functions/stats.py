"""Forecast skill as one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAIRS = 5


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    c = c.cast("double")
    return F.when(F.abs(c) < float("inf"), c)


def pearson(x: str, y: str) -> Column:
    """Correlation of complete pairs; null without variance. Rows with a null in either must be filtered before."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def compute_error(df: DataFrame, obs: str = "Observations", pred: str = "Predictions", by: Sequence[str] = (), digits: int | None = 6) -> DataFrame:
    """rho, MAE, CAE, RMSE and MAE_true of each group of ``by``.

    Pairs with a value that is null or not finite are left out; fewer than five leave all null. MAE is the largest
    signed error, obs - pred; MAE_true the mean absolute one.
    """
    e = F.col("_o") - F.col("_p")
    complete = (F.col("_o").isNotNull() & F.col("_p").isNotNull())
    pairs = df.select(*by, finite(F.col(f"`{obs}`")).alias("_o"), finite(F.col(f"`{pred}`")).alias("_p"))
    # incomplete pairs stay as nulls on both sides, so that groups without pairs keep their row
    pairs = pairs.select(*by, F.when(complete, F.col("_o")).alias("_o"), F.when(complete, F.col("_p")).alias("_p"))
    parts = {"rho": pearson("_o", "_p"), "MAE": F.max(e), "CAE": F.sum(F.abs(e)), "RMSE": F.sqrt(F.avg(e * e)), "MAE_true": F.avg(F.abs(e))}
    shown = lambda c: c if digits is None else F.round(c, digits)
    out = pairs.groupBy(*by).agg(F.count("_o").alias("_n"), *[c.alias(k) for k, c in parts.items()])
    return out.select(*by, *[F.when(F.col("_n") >= LEAST_PAIRS, shown(F.col(k))).alias(k) for k in parts])
