"""Series made of event and order tables: one aggregate each, whose result is as small as its number of time steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, x, y) of events: hour as a number yyyymmddhh, number of events, mean value to 4 places."""
    hour = F.date_format("ts", "yyyyMMddHH").cast("long")
    return table(spark, sf_dir, "events").groupBy(*by, hour.alias("t")).agg(F.count("*").cast("double").alias("x"), F.round(F.avg("value"), 4).alias("y"))


def monthly_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, y) of orders: month as a number yyyymm, number of orders, mean price to 2 places."""
    month = F.date_format("o_orderdate", "yyyyMM").cast("long")
    return table(spark, sf_dir, "orders").groupBy(month.alias("t")).agg(F.count("*").cast("double").alias("x"), F.round(F.avg("o_totalprice"), 2).alias("y"))


def vectors(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    """(t, e0.., label) of embeddings: the first components as columns of an embedded state."""
    parts = [F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(dims)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), *parts, F.col("label").cast("double").alias("label"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x, y) of orders, one step for each: key, price, day number. The long series among these."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").cast("double").alias("x"), day.alias("y"))
