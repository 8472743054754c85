"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into cells, several directions to a table. A
query visits the cells around its own in the order of their estimated chance to hold a neighbour, until those visited have
the chance asked for; candidates of all tables merge and are ranked by their exact cosine. Equal vectors are
indexed once. Buckets are dealt to shards, large ones in parts, so nothing depends on a bucket being small; a query goes to a
shard once, with the list of its buckets there, and comes back with its nearest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop, partitions

TABLES = 2
#: Chance that one of the tables finds a neighbour as near as the sample's.
FOUND = 0.985
#: Vectors from which the distance of neighbours is estimated; all are indexed.
SAMPLE = 2_048
#: Cell width in standard deviations of a projection, members that a bucket has about, members of a part of a large bucket.
WIDTH, BUCKET, PART = 1.0, 256, 4_096
#: Index rows of a shard, about; shards at least; visits of a shard that are searched together, about.
SHARD, LEAST_SHARDS, TOGETHER = 50_000, 24, 50_000
#: Queries whose probes found too little, and classes, that a tile compares.
EXACT = 4_096
#: Places beyond the k nearest that are kept until cosines are exact, for those that rounding makes swap.
SPARE = 4
REACH = 4
#: Lengths of vectors, each with its number of rows, that are broadcast at most.
LENGTHS = 10_000


class Hashes:
    """Random projections for one vector length: ``tables`` x ``functions`` directions and offsets."""

    def __init__(self, length: int, tables: int, functions: int, seed: int = 11):
        rng = np.random.default_rng([seed, length])
        self.length, self.tables, self.functions = length, tables, functions
        self.directions = rng.standard_normal((tables, functions, length))
        self.offsets = rng.uniform(0, WIDTH, (tables, functions))
        self.odd = rng.integers(1, 1 << 62, (tables, functions), dtype=np.int64) | 1

    def project(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables x functions."""
        return np.einsum("tfd,nd->ntf", self.directions, unit)

    def key(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A bucket number for cells of a table."""
        with np.errstate(over="ignore"):
            k = (cells.astype(np.int64) * self.odd[table]).sum(axis=-1)
            return (k ^ (k >> 31)) * np.int64(0x5851F42D4C957F2D) + np.int64(table * 1_000_003 + self.length)

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables."""
        cells = np.floor((self.project(unit) + self.offsets) / WIDTH)
        return np.stack([self.key(cells[:, t], t) for t in range(self.tables)], axis=1)

    def probes(self, unit: np.ndarray, cosine: float, chance: float) -> list[np.ndarray]:
        """For one vector, each table's buckets in estimated success order, until they hold ``chance``.

        Given a projection p, that of a neighbour is about normal around cosine * p; a cell's chance is the product over its
        directions. The best n combinations have prefixes among the best n, so each step keeps only those it needs.
        """
        out, spread = [], math.sqrt(max(1e-4, 1 - cosine * cosine))
        p = self.project(unit[None])[0]
        cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))
        for t in range(self.tables):
            mass, cells = np.ones(1), np.zeros((1, 0), np.int64)
            each = 1 - (1 - chance) / (2 * self.functions)
            for f in range(self.functions):
                at = cosine * p[t, f] + self.offsets[t, f]
                near = np.arange(math.floor((at - REACH * spread) / WIDTH), math.floor((at + REACH * spread) / WIDTH) + 1)
                share = np.diff(cdf((np.append(near, near[-1] + 1) * WIDTH - at) / spread))
                mass = (mass[:, None] * share).ravel()
                cells = np.concatenate((np.repeat(cells, len(near), 0), np.tile(near, len(cells))[:, None]), axis=1)
                order = np.argsort(-mass, kind="stable")
                # what is left out on the way costs little of the chance
                n = 1 + int(np.searchsorted(np.cumsum(mass[order]), mass.sum() * (each if f < self.functions - 1 else 1)))
                mass, cells = mass[order[:n]], cells[order[:n]]
            n = 1 + int(np.searchsorted(np.cumsum(mass), chance))
            out.append(self.key(cells[:n], t))
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: str):
    vectors = [np.frombuffer(x.as_py(), "<f8") for x in batch.column(column)]
    lengths = np.array([len(v) for v in vectors])
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, np.stack([vectors[i] for i in rows])


def _index(tables: int, functions: int):
    schema = pa.schema([("bucket", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            for d, rows, v in _by_length(b, "v"):
                keys = Hashes(d, tables, functions).buckets(_unit(v))
                ids, raw = b.column("ids").take(pa.array(rows)), b.column("v").take(pa.array(rows))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), ids, raw], schema=schema)

    return run


def _probe(tables: int, functions: int, cosine: float, chance: float):
    schema = pa.schema([("bucket", pa.int64()), ("query", pa.int64())])

    def run(batches):
        for b in batches:
            for d, rows, v in _by_length(b, "v"):
                hashes, unit = Hashes(d, tables, functions), _unit(v)
                for i, row in enumerate(rows):
                    keys = np.unique(np.concatenate(hashes.probes(unit[i], cosine, chance)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), b.column("query")[int(row)].as_py()))], schema=schema)

    return run


def rank_shard(queries: np.ndarray, asked: list[np.ndarray], candidates: np.ndarray, bucket: np.ndarray, ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's position, id, cosine) of the k nearest ids that each query finds in the buckets it asked for, ties to the smaller id.

    One bucket at a time, against all queries that asked for it; only the best so far are kept, and ranked by exact cosines at the end.
    """
    # a class that several tables bring stands once
    _, once, of = np.unique([x[0] for x in ids], return_index=True, return_inverse=True)
    candidates, ids = candidates[once], [ids[x] for x in once]
    q, c = _unit(queries), _unit(candidates)
    # among equal cosines, the class with the smaller first id
    later = np.arange(len(ids)) * (1e-13 / max(1, len(ids)))
    slots = k + SPARE
    best, best_at = np.full((len(q), slots), -np.inf), np.full((len(q), slots), -1)
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    members = {n: np.unique(of[rows]) for n, rows in zip(names.tolist(), np.split(order, first[1:]), strict=True)}
    who = np.repeat(np.arange(len(q)), [len(a) for a in asked])
    wanted = np.concatenate(asked) if len(asked) else np.zeros(0, np.int64)
    by = np.argsort(wanted, kind="stable")
    names, first = np.unique(wanted[by], return_index=True)
    for name, rows in zip(names.tolist(), np.split(who[by], first[1:]), strict=True):
        there = members.get(name)
        if there is None:
            continue
        for lo in range(0, len(rows), 2_048):
            r = rows[lo : lo + 2_048]
            s = np.concatenate((best[r], q[r] @ c[there].T - later[there]), axis=1)
            at = np.concatenate((best_at[r], np.broadcast_to(there, (len(r), len(there)))), axis=1)
            # a class met again is known
            s[:, slots:][(at[:, slots:, None] == at[:, None, :slots]).any(axis=2)] = -np.inf
            top = np.argpartition(-s, slots - 1, axis=1)[:, :slots]
            best[r], best_at[r] = np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
    i, slot = np.nonzero(best > -np.inf)
    j = best_at[i, slot]
    exact = (queries[i] * candidates[j]).sum(axis=1) / (np.linalg.norm(queries, axis=1)[i] * np.linalg.norm(candidates, axis=1)[j])
    found = [ids[x] for x in j]
    many = [len(x) for x in found]
    i, exact, found = np.repeat(i, many), np.repeat(exact, many), np.array([y for x in found for y in x], np.int64)
    order = np.lexsort((found, -exact, i))
    i, exact, found = i[order], exact[order], found[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], found[keep], exact[keep]


def _search(k: int):
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        vectors = lambda t: [np.frombuffer(x.as_py(), "<f8") for x in t.column("v")]
        q, c = vectors(right), vectors(left)
        ql, cl = np.array([len(x) for x in q]), np.array([len(x) for x in c])
        asked, ids, bucket = right.column("buckets").to_pylist(), left.column("ids").to_pylist(), np.asarray(left.column("bucket").combine_chunks())
        query, out = np.asarray(right.column("query").combine_chunks()), []
        for d in np.intersect1d(ql, cl):
            qi, ci = np.flatnonzero(ql == d), np.flatnonzero(cl == d)
            i, found, score = rank_shard(np.stack([q[x] for x in qi]), [np.array(asked[x], np.int64) for x in qi], np.stack([c[x] for x in ci]), bucket[ci], [ids[x] for x in ci], k)
            out.append(pa.Table.from_arrays([pa.array(query[qi][i]), pa.array(found), pa.array(score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _compared_with_all(classes: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """(query, id, score) from an exact search of all ``n`` classes for each of ``queries`` (query, v), by tiles of both."""
    down = max(1, -(-queries.count() // EXACT))
    across = max(1, -(-n // EXACT), min(-(-n // 64), -(-LEAST_SHARDS // down)))
    chunk = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = classes.select(every(down).alias("y"), chunk("query", across).alias("x"), F.lit(0).cast("long").alias("bucket"), F.col("ids").alias("ids"), F.col("v").alias("v"))
    right = queries.select(chunk("query", down).alias("y"), every(across).alias("x"), F.col("query").alias("query"), F.array(F.lit(0).cast("long")).alias("buckets"), F.col("v").alias("v"))
    return left.groupBy("y", "x").cogroup(right.groupBy("y", "x")).applyInArrow(_search(k), "query long, id long, score double")


def _packed(batches):
    schema = pa.schema([("id", pa.int64()), ("is_query", pa.bool_()), ("v", pa.binary())])
    for b in batches:
        v = [np.asarray(x, float) + 0.0 if (x := y.as_py()) else None for y in b.column("embedding")] if b.num_rows else []
        ok = [x is not None and bool(np.isfinite(x).all()) and bool(x.any()) for x in v]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("is_query"), pa.array([x.astype("<f8").tobytes() if o else None for x, o in zip(v, ok, strict=True)], pa.binary())], schema=schema)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, found: float = FOUND) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest rows found but itself, by cosine, ties to the smaller id.

    ``is_query`` is a condition on ``vectors`` that marks the queries; all rows are candidates. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do null ids; vectors of different length never meet.
    Rows repeated with id and vector count once. Fewer than ``k`` candidates give fewer rows; an empty table none.
    A query whose probes find fewer than that, or whose last find is farther than the neighbours probed for, is compared with all.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector_col).alias("embedding"))
    rows = rows.where("id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    packed = cut(rows.mapInArrow(_packed, "id long, is_query boolean, v binary").where("v IS NOT NULL"), "vectors")
    # of equal vectors, the k + 1 smallest ids can be among the k nearest; the limit holds in every task before the shuffle
    once = packed.groupBy("v", "id").agg(F.max("is_query").alias("is_query"))
    least = F.row_number().over(W.partitionBy("v", "is_query").orderBy("id"))
    classes = once.withColumn("_n", least).where(F.col("_n") <= k + 1).groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"), F.max("is_query").alias("asked"))
    classes = cut(classes.withColumn("query", F.element_at("ids", 1)), "classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    cosine = _neighbour_cosine(classes, n, k)
    functions = max(1, round(math.log2(max(2, n / BUCKET)) / math.log2(4.13 / WIDTH)))
    chance = 1 - (1 - found) ** (1 / tables)
    index = cut(classes.select("ids", "v").mapInArrow(_index(tables, functions), "bucket long, ids array<long>, v binary"), "index")
    asking = classes.where("asked").select("query", "v")
    probes = asking.repartition(4 * partitions(spark)).mapInArrow(_probe(tables, functions, cosine, chance), "bucket long, query long")
    # a large bucket has parts, each in a shard of its own; queries learn of them, and of empty buckets, by a join
    sizes = cut(index.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sizes")
    shards = max(LEAST_SHARDS, -(-n * tables // SHARD))
    to_shard = F.pmod(F.xxhash64("bucket", "part"), F.lit(shards)).cast("int").alias("shard")
    visits = probes.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(to_shard, "query", "bucket")
    visits = cut(visits.groupBy("shard", "query").agg(F.collect_set("bucket").alias("buckets")), "visits")
    # a row for each shard; only one that very many queries visit is there more than once
    rounds = F.broadcast(visits.groupBy("shard").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("rounds")))
    part = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts")).cast("int")
    left = index.join(sizes, "bucket").withColumn("part", part).select(to_shard, "bucket", "ids", "v").join(rounds, "shard")
    left = left.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1))).drop("rounds")
    right = visits.join(rounds, "shard").join(asking, "query").select("shard", F.pmod(F.xxhash64("query"), F.col("rounds")).cast("int").alias("round"), "query", "buckets", "v")
    at = ["shard", "round"]
    near = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_search(k + 1), "query long, id long, score double")
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))

    def merge(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
        return once.withColumn("_n", best).where(F.col("_n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "id")).alias("near"))

    merged = cut(merge(near), "nearest")
    # queries whose probes found fewer rows than there are, or only some farther than those probed for, are compared with all
    rows_of = classes.groupBy(F.octet_length("v").alias("length")).agg(F.sum(F.size("ids")).alias("rows"))
    wanted = asking.withColumn("length", F.octet_length("v")).join(F.broadcast(rows_of) if rows_of.count() <= LENGTHS else rows_of, "length").select(F.col("query").alias("of"), F.least(F.lit(k + 1), "rows").alias("wanted"))
    far = F.array_min(F.col("near.score"))
    enough = merged.join(wanted, F.col("query") == F.col("of")).where((F.size("near") >= F.col("wanted")) & ((far >= cosine) | (F.col("wanted") <= k))).select("query")
    short = cut(asking.join(enough, "query", "left_anti"), "short")
    if not short.isEmpty():
        merged = cut(merged.join(enough, "query", "left_semi").union(merge(_compared_with_all(classes, short, n, k + 1))), "nearest")
    drop(index, sizes, visits, short)
    asked = packed.where("is_query").select("id", "v").distinct().join(classes.select("v", "query"), "v").select(F.col("id").alias("query_id"), "query")
    order = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["id"] < b["id"], -1).otherwise(1)
    own = asked.join(merged, "query").select("query_id", F.slice(F.array_sort(F.filter("near", lambda x: x["id"] != F.col("query_id")), order), 1, k).alias("near"))
    out = own.select("query_id", F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def _neighbour_cosine(classes: DataFrame, n: int, k: int) -> float:
    """A low (tenth percentile) cosine of the k-th neighbour within a bounded sample; among more rows neighbours are nearer."""
    share = max(1, round(1_000_000_007 * min(1.0, SAMPLE / n)))
    some = classes.where(F.pmod(F.xxhash64("query"), F.lit(1_000_000_007)) < F.lit(share)).select("v").limit(2 * SAMPLE).collect()
    by: dict[int, list] = {}
    for r in some:
        by.setdefault(len(r["v"]), []).append(np.frombuffer(r["v"], "<f8"))
    unit = _unit(np.stack(max(by.values(), key=len))) if by else np.zeros((0, 1))
    if len(unit) <= k:
        return 0.0
    s = unit[:256] @ unit.T
    kth = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
    return float(np.clip(np.percentile(kth, 10), 0.0, 0.98))
