"""Hard-negative mining by distributed radix selection.

A negative for an anchor and a positive is a row of another label whose integer score with the anchor lies in a window below that of the
positive. The k best of a window are found by their digits: every tile of anchors and rows counts, for each window, its scores by their
highest digit; summed over tiles, the counts tell in which bucket the k-th best lies; the next pass counts
the next digit within that bucket, until the k-th score is known. Then each tile hands on only rows that reach that score.

Scores are never written. A tile sends of a window's histogram only the buckets down to the one its own k-th best is in, as the k-th best
of all cannot lie below, and of rows that reach the score the k first by (score, id): so copies of one vector, which have
one score with every anchor, send no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, drop

#: Bits of a digit.
DIGIT = 8
#: Anchors and rows of a tile at most, bytes of vectors on one of its sides, about; scores that are at hand together.
ANCHORS, ROWS, TILE, CELLS = 4_096, 8_192, 1 << 25, 4_000_000
#: Tiles at least, for there to be work for several executors.
LEAST_TILES = 24
#: Components are so large at most that all sums are exact in doubles.
EXACT = 1 << 52
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(vector, factor: float) -> np.ndarray | None:
    """floor(factor * x) of each component as whole doubles; None if one is missing or not finite."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore"):
        v = np.floor(factor * np.asarray(vector, np.float64))
    return v if len(v) and np.isfinite(v).all() else None


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond a long as the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda v: np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    return np.clip(whole(a) @ whole(b).T, LOWEST, HIGHEST).astype(np.int64)


def window(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score s with ``low * positive <= 100 * s <= high * positive``."""
    bounds = [(-((-low * p) // 100), (high * p) // 100) for p in positive.tolist()]
    clip = lambda x: max(LOWEST, min(HIGHEST, x))
    return np.array([clip(a) for a, _ in bounds], np.int64), np.array([clip(b) for _, b in bounds], np.int64)


def first_of(group: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each group by score, highest first, ties to the smaller id."""
    order = np.lexsort((id_, ~score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _packed(factor: float):
    schema = pa.schema([("no", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("anchor", pa.bool_()), ("v", pa.binary())])

    def run(batches):
        for b in batches:
            v = [scaled(x, factor) for x in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("no", "id", "label", "anchor")], pa.array([None if x is None else (x + 0.0).astype("<f8").tobytes() for x in v], pa.binary())], schema=schema)

    return run


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _tiled(left: pa.Table, right: pa.Table):
    """Yields (places of anchors, places of rows, scores) of a tile, vectors of one length at a time, some anchors at a time."""
    a, b = ([np.frombuffer(x.as_py(), "<f8") for x in t.column("v")] for t in (left, right))
    al, bl = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    for d in np.intersect1d(al, bl):
        i, j = np.flatnonzero(al == d), np.flatnonzero(bl == d)
        rows = np.stack([b[x] for x in j])
        step = max(1, CELLS // len(j))
        for at in range(0, len(i), step):
            part = i[at : at + step]
            yield part, j, scores(np.stack([a[x] for x in part]), rows)


def _positives(k: int):
    """The k first rows of an anchor's label in a tile."""
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        no, a_id, a_label = (_column(left, c) for c in ("no", "id", "label"))
        r_id, r_label = (_column(right, c) for c in ("id", "label"))
        for i, j, s in _tiled(left, right):
            own = (a_label[i][:, None] == r_label[j][None]) & (a_id[i][:, None] != r_id[j][None])
            if k < len(j):
                edge = np.partition(np.where(own, s, LOWEST), len(j) - k, axis=1)[:, len(j) - k]
                own &= s >= edge[:, None]
            x, y = np.nonzero(own)
            keep = first_of(x, s[x, y], r_id[j][y], k)
            x, y = x[keep], y[keep]
            out.append(pa.Table.from_arrays([pa.array(no[i][x]), pa.array(r_id[j][y]), pa.array(s[x, y])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _windows_of(left: pa.Table) -> list[tuple]:
    """For each anchor of a tile the arrays (window, lo, hi, prefix) of its open windows."""
    return [tuple(np.array([w[c] for w in ws], np.int64) for c in ("window", "lo", "hi", "prefix")) for ws in left.column("windows").to_pylist()]


def _histogram(k: int, shift: int):
    """(window, digit, n): how many rows of other labels have each digit at ``shift`` of (greatest score - score), among those whose higher digits are the window's prefix."""
    schema = pa.schema([("window", pa.int64()), ("digit", pa.int32()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        windows, digits, counts = [], [], []
        a_label, r_label, asked = _column(left, "label"), _column(right, "label"), _windows_of(left)
        for i, j, s in _tiled(left, right):
            for row, at in enumerate(i):
                own = s[row][r_label[j] != a_label[at]]
                for w, lo, hi, prefix in zip(*asked[at], strict=True):
                    gap = hi - own[(own >= lo) & (own <= hi)]
                    if shift + DIGIT < 64:
                        gap = gap[gap >> (shift + DIGIT) == prefix]
                    digit, n = np.unique((gap >> shift) & ((1 << DIGIT) - 1), return_counts=True)
                    # no deeper than this tile's own k-th best
                    upto = 1 + int(np.searchsorted(np.cumsum(n), k))
                    windows.append(np.full(len(digit[:upto]), w))
                    digits.append(digit[:upto])
                    counts.append(n[:upto])
        if not windows:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(windows)), pa.array(np.concatenate(digits).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int64))], schema=schema)

    return run


def _gather(k: int):
    """(window, negative, score): rows of other labels that reach the score of a window (its ``lo``), the k first of a tile."""
    schema = pa.schema([("window", pa.int64()), ("negative", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        a_label, r_label, r_id, asked = _column(left, "label"), _column(right, "label"), _column(right, "id"), _windows_of(left)
        for i, j, s in _tiled(left, right):
            for row, at in enumerate(i):
                other = r_label[j] != a_label[at]
                for w, lo, hi, _ in zip(*asked[at], strict=True):
                    y = np.flatnonzero(other & (s[row] >= lo) & (s[row] <= hi))
                    y = y[first_of(np.zeros(len(y), int), s[row][y], r_id[j][y], k)]
                    out.append((np.full(len(y), w), r_id[j][y], s[row][y]))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], schema=schema)

    return run


def _first(found: DataFrame, by: str, id_: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), id_))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, k: int = 3, low: int = 50, high: int = 95, factor: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the ``k`` hardest negatives of each anchor and positive.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; ``is_anchor`` marks the anchors among the others, and
    ``label`` may put another in a label's place. Components become floor(factor * x); a score is the inner product with the anchor,
    exact, and the nearest long where it is beyond one. Higher scores come first, ties by smaller id. An anchor's positives are its first
    rows of the same label but itself; negatives the first of other labels whose score is from ``low`` to ``high`` hundredths of
    the positive's. Vectors of different length never meet. Rows repeated with id, label and vector count once; of an id with several labels or vectors each is a
    row, but never its own positive or negative. Fewer rows give fewer results, an empty table none. Other columns are not read.
    """
    if not 0 <= low <= high:
        raise ValueError("hard_negatives: a window is from low to high hundredths of a positive's score, neither below 0")
    given = F.col(label_col) if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull(), given).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vector"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").withColumn("no", F.monotonically_increasing_id())
    packed = rows.select("no", "id", "label", "anchor", "vector").mapInArrow(_packed(factor), "no long, id long, label long, anchor boolean, v binary").where("v IS NOT NULL")
    packed = cut(packed.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor"), F.min("no").alias("no")), "vectors")
    anchors = packed.where("anchor").select("no", "id", "label", "v")
    n, n_anchors, longest = packed.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.max(F.octet_length("v"))).head()
    side = lambda most: max(256, min(most, TILE // (longest or 8)))
    down = max(1, -(-n_anchors // side(ANCHORS)))
    across = max(1, -(-n // side(ROWS)), min(-(-n // 256), -(-LEAST_TILES // down)))
    chunk = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    right = packed.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), chunk("no", across).alias("x"), "id", "label", "v").groupBy("y", "x")

    def over_tiles(left: DataFrame, kernel, schema: str) -> DataFrame:
        dealt = left.select(chunk("no", down).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), *[F.col(c).alias(c) for c in left.columns])
        return dealt.groupBy("y", "x").cogroup(right).applyInArrow(kernel, schema)

    near = _first(over_tiles(anchors, _positives(positives), "anchor long, positive long, score long"), "anchor", "positive", positives)
    pairs = cut(near.withColumn("window", F.monotonically_increasing_id()).mapInArrow(_with_window(low, high), "window long, anchor long, positive long, positive_score long, lo long, hi long").where("lo <= hi"), "pairs")
    span = pairs.agg(F.max(F.col("hi").cast("decimal(20,0)") - F.col("lo"))).head()[0]
    bits = int(span).bit_length() if span is not None else 0

    # the state of each window: digits found so far, and how many of the k lie in their bucket
    state = pairs.select("window", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("wanted"), F.lit(True).alias("open"))
    held = []
    for shift in range(DIGIT * (-(-bits // DIGIT) - 1), -1, -DIGIT):
        asked = _with_windows(anchors, pairs.join(state.where("open"), "window"))
        counts = over_tiles(asked, _histogram(k, shift), "window long, digit int, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
        so_far = counts.withColumn("upto", F.sum("n").over(W.partitionBy("window").orderBy("digit")))
        met = so_far.join(state.select("window", "wanted"), "window").where("upto >= wanted AND upto - n < wanted").select("window", F.col("digit").alias("found"), (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("left"))
        joined = state.join(met, "window", "left")
        # fewer than k rows in all: the whole window is wanted
        state = cut(joined.select("window", F.when(F.col("left").isNotNull(), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("found").cast("long"))).otherwise(F.col("prefix")).alias("prefix"), F.coalesce("left", "wanted").alias("wanted"), (F.col("open") & F.col("left").isNotNull()).alias("open")), "state")
        held.append(state)
    reach = pairs.join(state, "window").withColumn("lo", F.when(F.col("open"), F.col("hi") - F.col("prefix")).otherwise(F.col("lo")))
    found = over_tiles(_with_windows(anchors, reach), _gather(k), "window long, negative long, score long")
    best = _first(found, "window", "negative", k).select("window", "rank", F.col("negative").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(best, "window").join(anchors.select(F.col("no").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    out = cut(out.select("anchor_id", F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop(packed, pairs, *held)
    return out


def _with_window(low: int, high: int):
    schema = pa.schema([(c, pa.int64()) for c in ("window", "anchor", "positive", "positive_score", "lo", "hi")])

    def run(batches):
        for b in batches:
            lo, hi = window(np.asarray(b.column("score")), low, high)
            yield pa.RecordBatch.from_arrays([b.column("window"), b.column("anchor"), b.column("positive"), b.column("score"), pa.array(lo), pa.array(hi)], schema=schema)

    return run


def _with_windows(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``anchors`` that have windows, with the list of them: as many as an anchor has positives."""
    lists = pairs.groupBy("anchor").agg(F.collect_list(F.struct("window", "lo", "hi", "prefix")).alias("windows"))
    return anchors.join(lists, F.col("no") == F.col("anchor")).select("no", "id", "label", "v", "windows")
