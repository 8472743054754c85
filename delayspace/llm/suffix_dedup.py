"""Removal of byte strings that an earlier document has, by suffix arrays built with two-stage sorting.

Equal strings must meet in one shard. Every string of ``width`` bytes is owned by its anchor, that of its grams
with the least hash (the leftmost of equals), so equal strings have equal anchors; consecutive strings of one
anchor form a snippet. First only hashes of anchors and snippets are dealt by anchor: of equal snippets all but the
smallest document's are settled at once, within a task before the shuffle, so that a common passage comes to its anchor's bucket once
from each stretch of text that a task reads together, and by anchor after it. Where different
snippets share an anchor, and only there, their bytes are dealt by anchor, and each shard sorts its suffixes: those
smaller than their successors directly, the others by a scan over the buckets of their first bytes. Adjacent
common prefixes of ``width`` or more then tie equal strings, of which the smallest document keeps its own.
"""

from __future__ import annotations

import gc
import hashlib
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, partitions

WIDTH, GRAM = 50, 16
#: Bytes that a task hashes at once, and of documents for each bucket of anchors, about.
PIECE, BUCKET = 1 << 19, 16 << 20
#: Bytes whose suffixes are sorted at once, about; a larger group of snippets with one anchor is sorted as one.
SHARD = 1 << 20

_PLACE = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, the first the lowest; the end is filled with zeros."""
    w = np.zeros(len(data) + 8, np.uint64)
    w[: len(data)] = data
    w = w[:-1] | w[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    return (w[:-4] | w[4:] << np.uint64(32))[: len(data)]


def snippets(data: np.ndarray, doc: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first string's start, number of strings) of the snippets of concatenated documents.

    ``doc`` numbers the document of each byte. Anchors have 40 bits.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < width:
        return none
    w8, n = _words(data), len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        at = min(at, gram - 8)
        h = _mix(h ^ w8[at : at + n])
    m = h >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(n, dtype=np.uint64)
    del h
    span, grams = 1, width - gram + 1
    while span * 2 <= grams:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    if span < grams:
        m = np.minimum(m[: len(m) - (grams - span)], m[grams - span :])
    whole = doc[: len(m)] == doc[width - 1 : width - 1 + len(m)]
    starts = whole.copy()
    starts[1:] &= (m[1:] != m[:-1]) | ~whole[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return none
    stop = np.flatnonzero(whole & np.concatenate((starts[1:] | ~whole[1:], [True])))
    many = stop - first + 1
    # a polynomial over the mixed words, so that any stretch has a hash from two sums
    power = np.cumprod(np.full(len(data), _M1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(w8 & np.uint64(0xFF)) * power)))
    back = np.cumprod(np.full(len(data), np.uint64(pow(int(_M1), -1, 1 << 64))))
    content = _mix((total[stop + width] - total[first]) * back[first] ^ many.astype(np.uint64))
    return m[first] >> np.uint64(_PLACE), content, first, many


def two_stage_suffix_array(data: np.ndarray, depth: int = 56) -> np.ndarray:
    """Suffix array of ``data`` (small numbers), exact in the first ``depth`` places.

    Suffixes smaller than their successors are sorted directly. The rest is induced: scanning the buckets of first
    numbers upwards, each suffix in order puts its predecessor, if that is greater than it, behind those of its bucket.
    """
    n, data = len(data), data.astype(np.uint16)
    if n < 2:
        return np.arange(n)
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), n - 1)
    rises = np.append(data[ends[:-1]] < data[ends[:-1] + 1], False)
    small = np.repeat(rises, np.diff(np.concatenate(([-1], ends))))
    direct = _direct_sort(data, np.flatnonzero(small), depth)
    bounds = np.searchsorted(data[direct], np.arange(int(data.max()) + 2))
    waiting: list[list[np.ndarray]] = [[] for _ in range(int(data.max()) + 1)]
    last = n - 1  # the last suffix is greater than its (empty) successor: the least of its bucket
    waiting[int(data[last])].append(np.array([last]))
    out = []
    for c in range(len(waiting)):
        head = wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waves = [head]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[data[before] == c]
            waves.append(wave)
        bucket = np.concatenate((*waves, direct[bounds[c] : bounds[c + 1]]))
        waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[data[before] > c]
        if len(before):
            firsts = data[before]
            order = np.argsort(firsts, kind="stable")
            before, firsts = before[order], firsts[order]
            cuts = np.flatnonzero(firsts[1:] != firsts[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[int(data[part[0]])].append(part)
    return np.concatenate(out)


def _sevens(data: np.ndarray, beyond: int) -> np.ndarray:
    """Seven places from each position as one number that sorts as they do, nine bits a place; what is beyond the end sorts first."""
    x = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(beyond + 7, np.uint64)))
    n = len(data) + beyond
    w = np.zeros(n, np.uint64)
    for k in range(7):
        w = w << np.uint64(9) | x[k : k + n]
    return w


def _direct_sort(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by their first ``depth`` places, seven at a time; only ties are looked at again."""
    words = _sevens(data, depth)
    out, group, open_ = at.copy(), np.zeros(len(at), np.int64), np.arange(len(at))
    for step in range(0, depth, 7):
        if not len(open_):
            break
        word = words[out[open_] + step]
        order = np.lexsort((word, group[open_])) if step else np.argsort(word, kind="stable")
        out[open_], word, g = out[open_][order], word[order], group[open_][order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])))
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_ = open_[~new | np.append(~new[1:], False)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix in ``order`` with the one before, up to ``most``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    words, alive = _sevens(data, most), np.arange(1, len(order))
    for step in range(0, most, 7):
        x, y = words[order[alive] + step], words[order[alive - 1] + step]
        # the highest place in which they differ; places beyond the end of either never count as equal
        differs = np.zeros(len(alive), np.int64) + 7
        for k in range(6, -1, -1):
            shift = np.uint64(9 * (6 - k))
            px, py = x >> shift & np.uint64(511), y >> shift & np.uint64(511)
            differs[(px != py) | (px == 0)] = k
        out[alive] = step + differs
        alive = alive[differs == 7]
    return np.minimum(out, most)


def shared_strings(parts: list[bytes], doc: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each part, whether the string of ``width`` bytes from each of its places is also in a part of a smaller document."""
    lengths = np.array([len(p) for p in parts])
    # one is added to each byte, and zero separates parts
    data = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(lengths + 1) - 1
    data[ends] = 0
    owner = np.repeat(np.arange(len(parts)), lengths + 1)
    order = two_stage_suffix_array(data, max(width, 56))
    order = order[ends[owner[order]] - order >= width]
    hit = np.zeros(len(data), bool)
    if len(order):
        new = common_prefixes(data, order, width) < width
        least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(new))
        hit[order] = doc[owner[order]] > least[np.cumsum(new) - 1]
    return [hit[e - n : e - n + max(0, n - width + 1)] for e, n in zip(ends, lengths, strict=True)]


# What is dealt by anchor goes as one row for each bucket and piece, with columns packed as bytes.
_PACKED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("anchor", pa.binary()), ("content", pa.binary()), ("ix", pa.binary()), ("start", pa.binary()), ("many", pa.binary()), ("settled", pa.bool_()), ("bytes", pa.binary())])
_PACKED_SQL = "bucket int, docs binary, anchor binary, content binary, ix binary, start binary, many binary, settled boolean, bytes binary"


def _low(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _number(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(data) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return wide.view("<u8").ravel()


def _pack(bucket, docs, anchor, content, ix, start, many, settled, text=None) -> list[tuple]:
    """Rows for the buckets of these snippets. docs: (id, text hash) rows that ix points to; text: the snippets' bytes. Settled ones have neither anchor nor content."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for part in np.split(order, cuts):
        if not len(part):
            continue
        used, own = np.unique(ix[part], return_inverse=True)
        rows.append((int(bucket[part[0]]), docs[used].astype("<i8").tobytes(), _low(anchor[part], 5) if anchor is not None else b"", _low(content[part], 8) if content is not None else b"", own.astype("<u2" if len(used) <= 1 << 16 else "<u4").tobytes(), start[part].astype("<i4").tobytes(), many[part].astype(np.uint8).tobytes(), settled, b"".join([text[i] for i in part]) if text is not None else b""))
    return rows


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PACKED)], schema=_PACKED)


def _unpack(table: pa.Table):
    """(docs, anchor, content, doc place, start, many, settled, bytes) of all rows of a bucket."""
    docs, anchor, content, ix, start, many, settled, text, base = [], [], [], [], [], [], [], [], 0
    for r in table.to_pylist():
        d = np.frombuffer(r["docs"], "<i8").reshape(-1, 2)
        n = len(r["many"])
        docs.append(d)
        anchor.append(_number(r["anchor"], 5) if r["anchor"] else np.zeros(n, np.uint64))
        content.append(_number(r["content"], 8) if r["content"] else np.zeros(n, np.uint64))
        ix.append(np.frombuffer(r["ix"], "<u2" if len(d) <= 1 << 16 else "<u4").astype(np.int64) + base)
        start.append(np.frombuffer(r["start"], "<i4"))
        many.append(np.frombuffer(r["many"], np.uint8).astype(np.int64))
        settled.append(np.full(n, r["settled"]))
        text.append(r["bytes"])
        base += len(d)
    return [np.concatenate(x) for x in (docs, anchor, content, ix, start, many, settled)] + [b"".join(text)]


def _hash_pieces(n_buckets: int, width: int, gram: int):
    """Snippet hashes of documents, by bucket; those that a smaller document of the same piece has are settled."""

    def piece(parts, docs, offsets):
        data = np.frombuffer(b"".join(parts), np.uint8)
        doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        anchor, content, first, many = snippets(data, doc, width, gram)
        ix = doc[first] if len(first) else np.zeros(0, np.int64)
        begins = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        start = first - begins[ix] + offsets[ix]
        settled = np.zeros(len(anchor), bool)
        if len(anchor):
            ids = docs[ix, 0]
            order = np.lexsort((ids, content, anchor))
            new = np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])))
            least = ids[order][new][np.cumsum(new) - 1]
            settled[order] = ids[order] > least
        live, done = np.flatnonzero(~settled), np.flatnonzero(settled)
        rows = _pack((anchor[live] % np.uint64(n_buckets)).astype(np.int32), docs, anchor[live], content[live], ix[live], start[live], many[live], False)
        # all settled ones of the piece to one bucket, a piece here and a piece there: nothing is matched with them any more
        at = int(_mix(np.array([docs[0, 0]]).astype(np.uint64))[0] % np.uint64(n_buckets)) if len(done) else 0
        return _packed(rows + _pack(np.full(len(done), at, np.int32), docs, None, None, ix[done], start[done], many[done], True))

    def run(batches):
        for b in batches:
            parts, docs, offsets, held = [], [], [], 0
            for id_, th, text in zip(*(b.column(k) for k in ("id", "th", "text")), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for at in range(0, max(0, len(data) - width + 1), PIECE):
                    part = data[at : at + PIECE + width - 1]
                    parts.append(part)
                    docs.append((id_.as_py(), th.as_py()))
                    offsets.append(at)
                    held += len(part)
                    if held >= PIECE:
                        yield piece(parts, np.array(docs, np.int64), np.array(offsets))
                        parts, docs, offsets, held = [], [], [], 0
            if parts:
                yield piece(parts, np.array(docs, np.int64), np.array(offsets))

    return run


_FOUND = pa.schema([("id", pa.int64()), ("th", pa.int32()), ("anchor", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("settled", pa.bool_())])
_FOUND_SQL = "id long, th int, anchor long, a int, b int, settled boolean"


def _found(docs, ix, anchor, a, b, settled) -> pa.Table:
    return pa.Table.from_arrays([pa.array(docs[ix, 0]), pa.array(docs[ix, 1].astype(np.int32)), pa.array(anchor.astype(np.int64), mask=settled), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(settled)], schema=_FOUND)


def _match_hashes(width: int):
    """Covered stretches [a, b) of snippets that a smaller document has as they are (settled), and the starts a and string counts b of those whose bytes are to be looked at."""

    def run(table: pa.Table) -> pa.Table:
        docs, anchor, content, ix, start, many, settled, _ = _unpack(table)
        live = np.flatnonzero(~settled)
        ids = docs[ix, 0]
        order = live[np.lexsort((ids[live], content[live], anchor[live]))]
        differs = lambda x: np.concatenate(([True], x[order][1:] != x[order][:-1]))[: len(order)]
        by_anchor = differs(anchor)
        new = by_anchor | differs(content)
        if len(order):
            least = ids[order][new][np.cumsum(new) - 1]
            settled[order] = ids[order] > least
            group = np.cumsum(by_anchor) - 1
            contents = np.bincount(group, weights=new)
            lowest, highest = np.minimum.reduceat(ids[order], np.flatnonzero(by_anchor)), np.maximum.reduceat(ids[order], np.flatnonzero(by_anchor))
            open_ = order[(contents > 1)[group] & (lowest < highest)[group] & ~settled[order]]
        else:
            open_ = order
        done = np.flatnonzero(settled)
        return pa.concat_tables([
            _found(docs, ix[done], anchor[done], start[done], start[done] + many[done] - 1 + width, np.ones(len(done), bool)),
            _found(docs, ix[open_], anchor[open_], start[open_], many[open_], np.zeros(len(open_), bool)),
        ])

    return run


def _cut_snippets(n_buckets: int, width: int):
    """The bytes of the snippets asked for, by bucket."""

    def run(batches):
        for b in batches:
            todo, docs, held = [], [], 0
            for id_, th, text, asked in zip(*(b.column(k) for k in ("id", "th", "text", "asked")), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                flat = asked.values
                anchor, a, n = (np.asarray(flat.field(k)) for k in ("anchor", "a", "b"))
                docs.append((id_.as_py(), th.as_py()))
                todo += [(h, len(docs) - 1, s, m, data[s : s + m - 1 + width]) for h, s, m in zip(anchor.tolist(), a.tolist(), n.tolist(), strict=True)]
                held += sum(n.tolist()) + len(n) * width
                if held >= PIECE:
                    yield _cut_rows(todo, docs, n_buckets)
                    todo, docs, held = [], [], 0
            if todo:
                yield _cut_rows(todo, docs, n_buckets)

    return run


def _cut_rows(todo, docs, n_buckets: int) -> pa.RecordBatch:
    anchor = np.array([x[0] for x in todo], np.uint64)
    ix, start, many = (np.array([x[k] for x in todo], np.int64) for k in (1, 2, 3))
    return _packed(_pack((anchor % np.uint64(n_buckets)).astype(np.int32), np.array(docs, np.int64), anchor, None, ix, start, many, False, [x[4] for x in todo]))


def _sort_shard(width: int):
    """Covered stretches within snippets that share an anchor, from suffix arrays over whole groups of anchors."""

    def run(table: pa.Table) -> pa.Table:
        docs, anchor, _, ix, start, many, _, text = _unpack(table)
        ends = np.cumsum(many - 1 + width)
        order = np.argsort(anchor, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])))
        # whole groups, about SHARD bytes together
        size = np.cumsum((many - 1 + width)[order])
        cuts, held = [], 0
        for at in new[1:]:
            if size[at - 1] - held >= SHARD:
                cuts.append(at)
                held = size[at - 1]
        out = []
        for part in np.split(order, cuts):
            hits = shared_strings([text[ends[i] - many[i] + 1 - width : ends[i]] for i in part], docs[ix[part], 0], width)
            flat = np.concatenate([np.append(h, False) for h in hits]).astype(np.int8)
            edge = np.diff(np.concatenate(([0], flat)))
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            begins = np.concatenate(([0], np.cumsum(many[part] + 1)))
            k = np.searchsorted(begins, lo, side="right") - 1
            at = start[part][k] - begins[k]
            out.append(_found(docs, ix[part][k], anchor[part][k], at + lo, at + hi - 1 + width, np.ones(len(lo), bool)))
        return pa.concat_tables(out)

    return run


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches [a, b) merged where they touch or overlap."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


_KEPT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("kept", pa.binary())])


def _kept_batches(digest: bool):
    def run(batches):
        for batch in batches:
            out = []
            for id_, text, found in zip(batch.column("id"), batch.column("text"), batch.column("found"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                flat = found.values
                a, b = merged(np.asarray(flat.field("a")).astype(np.int64), np.asarray(flat.field("b")).astype(np.int64)) if flat is not None else (np.zeros(0, np.int64),) * 2
                edges = [0, *np.stack((a, b), 1).ravel().tolist(), len(data)]
                kept = b"".join([data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
                out.append((id_.as_py(), len(data), a, b, hashlib.sha256(kept).digest() if digest else kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_KEPT)], schema=_KEPT)

    return run


def _free(spark) -> None:
    """Let Spark delete the shuffle files of what was written: it does soon after the driver's objects are collected."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _by_anchor(packed: DataFrame, each, label: str) -> DataFrame:
    """What ``each`` makes of every bucket, as a table; the exchange is gone when this returns."""
    spark, out = packed.sparkSession, cut(packed.groupBy("bucket").applyInArrow(each, _FOUND_SQL), label)
    del packed
    _free(spark)
    return out


def _with(docs: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """Documents with what was found in them, as a list ``asked``."""
    lists = found.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    return docs.join(lists, ["id", "th"]).select("id", "th", "text", "asked")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, a, b (removed stretches [a, b), sorted and apart), kept (bytes, or their SHA-256 with ``digest``).

    A byte is removed if a string of ``width`` bytes that covers it also starts in a document with a smaller id. Texts are
    judged as they are in the input, as UTF-8; null counts as empty. ``width`` is below 256, and above ``gram``. Rows without an id neither remove nor lose bytes. Rows that
    repeat an id are not smaller than one another. An empty table gives an empty result.
    """
    if not gram < width < 256 or gram < 8:
        raise ValueError("repeated_bytes: 8 <= gram < width < 256")
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_buckets = max(partitions(spark), -(-size // BUCKET))
    whole = slim.where("id IS NOT NULL")
    first = _by_anchor(whole.mapInArrow(_hash_pieces(n_buckets, width, gram), _PACKED_SQL), _match_hashes(width), "anchors")
    second = _by_anchor(_with(whole, first.where("NOT settled"), "anchor", "a", "b").mapInArrow(_cut_snippets(n_buckets, width), _PACKED_SQL), _sort_shard(width), "strings")
    settled = first.where("settled").union(second)
    found = cut(settled.groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("found")), "stretches")
    del settled
    drop(first, second)
    _free(spark)
    return (
        slim.join(found, ["id", "th"], "left").select("id", "text", "found")
        .mapInArrow(_kept_batches(digest), "id long, n_bytes long, a array<long>, b array<long>, kept binary")
        .withColumnRenamed("id", id_col)
    )
