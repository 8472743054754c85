"""Periodic run detection by a scan of all lags.

Words become numbers, and a document's array of them is compared with itself shifted by each lag q up to n / (least exponent). A
stretch of so many equal places is a run: words that repeat with period q. At a block of lags, a few places are compared
first: a stretch that is long enough covers some of them, so most lags end there, and the others are compared in full.

A lag costs at most n comparisons, a document n * n / 4. Spark deals out ranges of lags: a document whose lags may cost more
than WORK by its bytes is read by several tasks, each of which scans its own range, and their runs meet again by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Least words of a run, and least number of times that its period goes into it.
LEAST, TIMES = 6, 4
#: Comparisons that a range of lags may cost at most, about.
WORK = 1 << 32

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words(text: str | None) -> list[bytes]:
    """Stretches without ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(found: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int32, len(found))


def likely_lags(ids: np.ndarray, lags: range, least: int, times: int):
    """Those of ``lags`` at which some stretch may be long enough.

    Lags go in blocks, a few places against all lags of a block: a stretch of m equal places covers a multiple of m - 1 and the place
    after it, so places that far apart, in pairs, tell for all lags whose stretches are at least as long.
    """
    n = len(ids)
    widest = max(16, lags.stop // 2)
    padded = np.concatenate((ids, np.full(widest + 2, -1, ids.dtype)))
    shifted = np.lib.stride_tricks.sliding_window_view(padded, widest)
    q = lags.start
    while q < min(lags.stop, n):
        width = min(lags.stop - q, max(16, q // 2))
        stride = max(least, times * q) - q - 1
        met = shifted[q:n:stride, :width] == padded[: n - q : stride, None]
        met &= shifted[q + 1 : n + 1 : stride, :width] == padded[1 : n - q + 1 : stride, None]
        yield from (q + np.flatnonzero(met.any(axis=0))).tolist()
        q += width


def lag_runs(ids: np.ndarray, lags: range, least: int = LEAST, times: int = TIMES) -> dict[tuple[int, int], int]:
    """{(start, end): smallest of ``lags`` that is a period}, of maximal stretches that are long enough for their lag."""
    n, out = len(ids), {}
    if n < least:
        return out
    for q in likely_lags(ids, lags, least, times):
        need = max(least, times * q) - q
        same = ids[: n - q] == ids[q:]
        edge = np.flatnonzero(same[1:] != same[:-1]) + 1
        edge = np.concatenate(([0], edge, [n - q]))
        first = 0 if same[0] else 1
        starts, ends = edge[first:-1:2], edge[first + 1 :: 2]
        long_ = ends - starts >= need
        for s, e in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True):
            # a stretch met at a smaller lag has that as its period, and q is a multiple of it
            out.setdefault((s, e + q), q)
    return out


def last_lag(n: int, times: int = TIMES) -> int:
    return n // times


def runs_of(found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """(start, length, period), by start, then period."""
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties to the smallest start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words but those that a run holds after its first period, joined by spaces."""
    if runs:
        turns = np.zeros(len(found) + 1, np.int32)
        for s, length, q in runs:
            turns[s + q] += 1
            turns[s + length] -= 1
        kept = np.flatnonzero(np.cumsum(turns[:-1]) == 0)
        found = [found[i] for i in kept.tolist()]
    return b" ".join(found).decode("utf-8", "surrogatepass")


_OUT = pa.schema([("id", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])
#: Characters of results that a batch holds, about.
BATCH = 4_000_000


def _told(rows):
    """Batches of (id, runs, collapsed) from rows (id, words, runs)."""
    ids, runs, best, texts, held = [], [], [], [], 0

    def batch():
        spelt = lambda r: None if r is None else {"start": r[0], "length": r[1], "period": r[2]}
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[spelt(r) for r in x] for x in runs], pa.list_(_RUN)), pa.array([spelt(r) for r in best], _RUN), pa.array(texts, pa.string())], schema=_OUT)

    for i, found, own in rows:
        ids.append(i)
        runs.append(own)
        best.append(strongest(own))
        texts.append(collapsed(found, own))
        held += len(texts[-1]) + 32 * len(own) + 64
        if held > BATCH:
            yield batch()
            ids, runs, best, texts, held = [], [], [], [], 0
    if ids:
        yield batch()


def _whole(least: int, times: int):
    """(id, text): documents all of whose lags one task scans."""

    def rows(batches):
        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                found = words(t.as_py())
                yield i, found, runs_of(lag_runs(numbered(found), range(1, last_lag(len(found), times) + 1), least, times))

    return lambda batches: _told(rows(batches))


def _part(least: int, times: int):
    """(place, text, range, ranges): a range of the lags of a document."""
    schema = pa.schema([("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            for place, t, k, of in zip(b.column("place").to_pylist(), b.column("text"), b.column("range").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                ids = numbered(words(t.as_py()))
                last = last_lag(len(ids), times)
                got = lag_runs(ids, range(1 + last * k // of, 1 + last * (k + 1) // of), least, times)
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(got), pa.int64()), *[pa.array(x, pa.int64()) for x in ([s for s, _ in got], [e for _, e in got], list(got.values()))]], schema=schema)

    return run


def _met(batches):
    """(id, text, runs): documents whose runs have come together again."""

    def rows():
        for b in batches:
            for i, t, found in zip(b.column("id").to_pylist(), b.column("text"), b.column("found").to_pylist(), strict=True):
                yield i, words(t.as_py()), runs_of({(x["start"], x["end"]): x["period"] for x in found or []})

    return _told(rows())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, work: int = WORK) -> DataFrame:
    """One row for each row of ``docs``: id, runs (start, length, period; by start, then period), best (the run with the greatest length / period), collapsed.

    Words are stretches without ASCII white space, numbered from 0. A run is a stretch of consecutive words with smallest period q, of
    ``max(least, times * q)`` words or more, that no neighbouring word extends. ``collapsed`` joins by spaces the words that
    no run holds after its first q words. Null and empty texts have no words, no runs, a null best and an empty ``collapsed``. Null ids and repeated rows are
    reported each; an empty table gives an empty result. Only the id and the text are read.
    """
    if times < 2 or least < 3:
        raise ValueError("periodic_runs: a run has three words at least, and repeats its period twice or more")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a word and its white space take two bytes at least
    most = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("double") + 1) / 2
    sized = rows.withColumn("ranges", F.greatest(F.ceil(most * most / times / F.lit(work)), F.lit(1)).cast("int"))
    schema = f"id long, runs array<{RUN}>, best {RUN}, collapsed string"
    out = sized.where("ranges = 1").select("id", "text").mapInArrow(_whole(least, times), schema)
    # documents that are too long for one task are few, and there may be none
    long_ = cut(sized.where("ranges > 1").withColumn("place", F.monotonically_increasing_id()), "long")
    if not long_.isEmpty():
        ranges = long_.select("place", "text", "ranges", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
        tasks = long_.agg(F.sum("ranges")).head()[0]
        found = ranges.repartition(int(min(tasks, 100_000)), "place", "range").mapInArrow(_part(least, times), "place long, start long, end long, period long")
        # of two lags with one stretch, the smaller is its period
        runs = found.groupBy("place", "start", "end").agg(F.min("period").alias("period"))
        lists = runs.groupBy("place").agg(F.collect_list(F.struct("start", "end", "period")).alias("found"))
        out = out.union(long_.join(lists, "place", "left").select("id", "text", "found").mapInArrow(_met, schema))
    return out.withColumnRenamed("id", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of ``docs``, where every tenth text, told by a hash of its id, goes round from some word on.

    With h = crc32(decimal id) and g = floor(h / 10), a text of n words whose h is a multiple of ten has word i >= a = g % n replaced by word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id plants nothing.
    """
    h, text = F.crc32(F.col(id_col).cast("string").cast("binary")), F.col(text_col)
    g = F.floor(h / 10)
    whole = lambda c: c.cast("int")

    def turned(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.flatten(F.array_repeat(F.slice(w, whole(a + 1), whole(p)), whole(F.ceil((n - a) / p))))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), whole(a)), F.slice(again, F.lit(1), whole(n - a))), " "))

    # as the variable of a lambda the words are found once, wherever the optimiser puts the expression
    found = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    made = F.when(h % 10 == 0, F.element_at(F.transform(F.array(found), turned), 1))
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(made, text).alias(text_col))
