"""Exact dedup by a tree merge of sorted digest runs.

Every input partition is one run: its texts' digests, sorted, each with the smallest identifier
seen. In each round 2**k neighbouring runs meet (k rounds of a binomial tree done by one multiway
merge): runs are sorted by digest, equal digests merge, and of their rows the smallest identifier
is kept. Digest and length must both agree, so a merge is verified at every level. The decisions
then go back down the same tree, parent to child, so that no key ever meets more than
2**k rows above the leaves, however many copies a text has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, aside, cut, drop

#: Runs that one multiway merge takes: four binomial rounds.
FAN_IN = 16


def normalised(text) -> F.Column:
    """Null counts as empty; every run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (see :func:`normalised`) the row with the smallest id is kept. Null ids come after all
    others; of repeated rows with one id and text, one is kept. An empty table gives an empty result.
    Other columns of ``docs`` are not read, so their names cannot clash.
    """
    text = normalised(F.col(text_col))
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            F.octet_length(text).alias("n_bytes"),
            F.monotonically_increasing_id().alias("place"),
            F.spark_partition_id().alias("run"),
        ),
        "digests",
    )
    key = ["digest", "n_bytes"]
    best = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("place"))
    runs = rows.groupBy("run", *key).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    levels = [cut(runs, "runs")]
    top = levels[0].agg(F.max("run")).head()[0] or 0
    while top > 0:
        merged = levels[-1].groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *key)
        levels.append(cut(merged.agg(F.min("best").alias("best"), F.sum("n").alias("n")), "runs"))
        top //= fan_in

    decided = levels[-1]
    for below in reversed(levels[:-1]):
        child = below.select(F.col("run").alias("child"), *key, F.floor(F.col("run") / fan_in).cast("int").alias("run"))
        decided = child.join(decided, ["run", *key]).select(F.col("child").alias("run"), *key, "best", "n")
    out = rows.join(decided, ["run", *key]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("place") == F.col("best.place")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    if len(levels) > 2:
        done = cut(out, "exact")
        drop(rows, *levels)
        return done
    return out


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its exact copies, all columns as they were.

    Texts move once, to meet the list of rows that go. Only where rows repeat an id with its text, which that
    list cannot tell apart, are they numbered as well.
    """
    gone = exact_dedup(docs, id_col, text_col).where("NOT kept").select(F.col(id_col).alias("gone_id"), "keep_id", F.col("text_sha256").alias("gone_sha"))
    gone = cut(gone, "copies")
    other = ~F.col("gone_id").eqNullSafe(F.col("keep_id"))
    rows = aside(docs, id=F.col(id_col), sha=F.sha2(normalised(F.col(text_col)), 256))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    out = rows.join(gone.where(other), same, "left_anti")
    if not gone.where(~other).isEmpty():
        turn = F.row_number().over(W.partitionBy("id", "sha").orderBy(F.monotonically_increasing_id()))
        out = out.withColumn("turn", turn).where("turn = 1")
    return out.select("row.*")
