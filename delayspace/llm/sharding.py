"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many points of a ring, and a key belongs to the first point clockwise of its hash. A shard holds no more
rows than its bound: what comes beyond goes on clockwise to the next point whose shard has room. Points depend on a
shard's number only, so a further shard takes over stretches of the ring and leaves the others where they are, but for what
the bounds push on.

Rows are ranked along the ring by ranges. Whether a shard is full is a matter of numbers of rows: one count for each stretch between two points, as many as
there are points whatever the table, says which ranks of a stretch stay and where the others go. Each row then finds its shard and
its slot from its rank, without meeting others.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ranked

#: Points of a shard on the ring.
POINTS = 128
#: Parts of the ring in which a hash is looked up.
PARTS = 12
SEED = 5


def ring(shards: int, points: int = POINTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(points in the order of signed 64-bit hashes, shard of each)."""
    all_ = {}
    for s in range(shards):
        for r in range(points):
            all_.setdefault(int(np.uint64(xxhash.xxh64_intdigest(f"{s}/{r}", seed)).astype(np.int64)), s)
    at = sorted(all_)
    return np.array(at, np.int64), np.array([all_[x] for x in at], np.int64)


def bounds(n: int, shards: int, slack: float) -> np.ndarray:
    """Most rows of each shard: without slack, the first n % shards take one more than the others, which adds up to n."""
    if slack:
        return np.full(shards, int(np.ceil((1 + slack) * n / shards)))
    return np.full(shards, n // shards) + (np.arange(shards) < n % shards)


def pieces(counts: np.ndarray, owner: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(stretch, first rank, end, shard, first slot): which ranks of each stretch of the ring go to which shard.

    There is a stretch before each point, and one beyond the last, which comes to the first. Rows come to their own point first, for which points are taken in the order of the ring; those a full shard has no room for
    go on together, one point a round. Of a stretch, lower ranks find room first.
    """
    held, out = np.zeros(len(most), np.int64), []
    moving = [(s, 0, int(c), s % len(owner)) for s, c in enumerate(counts) if c]
    while moving:
        on = []
        for stretch, lo, hi, at in moving:
            shard = int(owner[at])
            room = min(hi - lo, int(most[shard] - held[shard]))
            if room > 0:
                out.append((stretch, lo, lo + room, shard, int(held[shard])))
                held[shard] += room
                lo += room
            if lo < hi:
                on.append((stretch, lo, hi, (at + 1) % len(owner)))
        moving = on
    return out


def _placed_on_ring(rows: DataFrame, at: np.ndarray) -> DataFrame:
    """``rows`` with the stretch that their ``hash`` is in: the number of points before it."""
    part = lambda x: x >> (64 - PARTS)
    table = [(p, int(np.searchsorted(at, int(np.int64(p) << (64 - PARTS)))), [int(x) for x in at[part(at) == p]]) for p in range(-(1 << (PARTS - 1)), 1 << (PARTS - 1))]
    # its size is that of the ring, whatever the rows
    parts = rows.sparkSession.createDataFrame(table, "part long, before long, at array<long>")
    found = rows.join(F.broadcast(parts), F.shiftright("hash", 64 - PARTS) == F.col("part"))
    return found.withColumn("stretch", (F.col("before") + F.size(F.filter("at", lambda x: x < F.col("hash")))).cast("int")).drop("part", "before", "at")


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS, slack: float = 0.0, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: id, size (UTF-8 bytes of the text and 16; null: 16), text_crc32, shard, slot (0.. in each shard).

    A row's key is its id, or for a null id its text. A shard holds ``ceil((1 + slack) * rows / shards)`` rows at most; without slack
    numbers of rows are at most one apart. More slack moves fewer rows when a shard is added. Repeated rows are placed each, next to each other on the ring, and spread
    like others where a shard is full; copies of a text under other ids are not kept together. Reruns agree, but for which of rows that
    are alike in id, size and checksum gets which slot. An empty table gives an empty result. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shard_rows: one shard is needed at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    at, owner = ring(shards, points, seed)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = rows.withColumn("hash", F.when(F.col("id").isNull(), F.xxhash64("crc", "size", F.lit(seed))).otherwise(F.xxhash64("id", F.lit(seed))))
    rows = rows.withColumn("turn", F.monotonically_increasing_id())
    placed = ranked(rows, "hash", "id", "size", "crc", "turn", name="rank", label="ring").drop("turn")
    placed = cut(_placed_on_ring(placed, at), "placed")
    counts, firsts = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
    for r in placed.groupBy("stretch").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect():
        counts[r["stretch"]], firsts[r["stretch"]] = r["n"], r["first"]
    by: dict[int, list] = {}
    for stretch, *piece in pieces(counts, owner, bounds(int(counts.sum()), shards, slack)):
        by.setdefault(stretch, []).append(tuple(piece))
    plan = docs.sparkSession.createDataFrame([(s, int(firsts[s]), p) for s, p in by.items()], "stretch int, first long, pieces array<struct<lo:long,hi:long,shard:int,slot:long>>")
    found = placed.join(F.broadcast(plan), "stretch").withColumn("own", F.col("rank") - F.col("first"))
    found = found.withColumn("x", F.element_at(F.filter("pieces", lambda x: (x["lo"] <= F.col("own")) & (F.col("own") < x["hi"])), 1))
    return found.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("x.shard").alias("shard"), (F.col("x.slot") + F.col("own") - F.col("x.lo")).alias("slot"))
