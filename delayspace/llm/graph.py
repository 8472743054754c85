"""Connected components over an edge table, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


#: A node is a hub if it ends more edges than this, and more than one part in so many of all: of those there are fewer than HUBS.
DEGREE, HUBS = 1_000, 100_000


def _with_lowest(edges: DataFrame) -> DataFrame:
    """(u, v, m): edges with the least neighbour m of u, or u itself where that is less.

    Edges of hubs stay where they are, as a hub's m is broadcast, so that no task has all of them; the others meet it by a join.
    """
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    lowest = cut(lowest, "lowest")
    hub = F.col("n") > max(DEGREE, (lowest.agg(F.sum("n")).head()[0] or 0) // HUBS)
    hubs, others = lowest.where(hub).select("u", "m"), lowest.where(~hub).select("u", "m")
    if hubs.isEmpty():
        return edges.join(others, "u").select("u", "v", "m")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return rest.join(others, "u").select("u", "v", "m").union(edges.join(F.broadcast(hubs), "u").select("u", "v", "m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v), v < u, has one v, and no v is a u: then each v is its component's least node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("downs"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("ups").alias("ups"), F.sum("downs").alias("downs"))
    return ends.where("ups > 1 OR (ups = 1 AND downs > 0)").count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Alternating stars: a large-star round ties every larger neighbour of a node to the node's smallest
    neighbour, a small-star round ties the smaller ones to it; once only stars are left it ends. The smallest neighbour is a partial
    aggregate, so a hub sends one row for each task; see :func:`_with_lowest` for how it is handed out. Each round is written to the shared folder. Null ends and loops
    are left out; an empty table gives an empty result.
    """
    now = cut(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "edges")
        drop(now)
        small = _with_lowest(large)
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small, "edges")
        drop(large)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
