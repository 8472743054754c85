"""Secret scans with corpus-wide ownership frequency.

Candidates are strings that look like credentials, of base and of wider kinds. Hashes of all their values are counted over the
corpus's distinct repositories and owners, wherever they stand, in overlapping candidates too: a value that many of either hold is a
copied example, one that few hold looks live. Every reported span carries its value's counts. Those of the base kinds are always
reported, those of wider kinds if they look live; overlaps are resolved among what is reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Base kinds in the order of reports: pattern, group whose length counts, least length. Runs of one class carry the least length in the pattern.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]{12,}"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: Wider kinds: pattern, group that holds the value.
WIDER = (
    ("bearer", re.compile(r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})"), 1),
    ("prefixed", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_|glpat-|xox[abpr]-|sk-|pk_live_|sk_live_|AIza)[A-Za-z0-9_-]{16,}"), 0),
    ("url", re.compile(r"://[^\s:/@]+:([^\s:/@]{6,})@"), 1),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), 0),  # and on to its end mark, or else to the next mark or the text's end
    ("random", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])"), 0),
)
_PEM_MARK = re.compile(r"-----(?:BEGIN |END (?:[A-Z ]{0,30}PRIVATE KEY-----)?)")
KINDS = [k for k, *_ in (*BASE, *WIDER)]
#: Bits a character and kinds of characters that a "random" value has at least.
ENTROPY, CLASSES = 3.5, 3
#: More distinct owners, or repositories, than this make a value a copied example.
OWNERS, REPOSITORIES = 1, 3
#: A value is common that more candidates than this have, and more than one in so many.
COMMON, RATIO = 10_000, 10_000


def _random(value: str) -> bool:
    classes = any(c.isdigit() for c in value) + any("a" <= c <= "z" for c in value) + any("A" <= c <= "Z" for c in value)
    return classes >= CLASSES and -sum(n / len(value) * math.log2(n / len(value)) for n in map(value.count, set(value))) >= ENTROPY


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of base candidates, leftmost non-overlapping for each kind, failing matches dropped; code points."""
    out, text = [], text or ""
    for k, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _hash(value: str) -> bytes:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:16]


def base_candidates(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, kind's place, end, hash of the value) of :func:`base_spans`."""
    return [(a, k, b, _hash(BASE[k][1].match(text, a, b)[BASE[k][2]])) for a, k, b in base_spans(text)]


def wider_candidates(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, kind's place, end, hash of the value) of all wider candidates, overlapping ones included."""
    out, text = [], text or ""
    for k, (kind, pattern, group) in enumerate(WIDER, len(BASE)):
        found = list(pattern.finditer(text))
        marks = list(_PEM_MARK.finditer(text)) if kind == "pem" and found else []
        starts = [m.start() for m in marks]
        for m in found:
            end, value = m.end(), m[group]
            if kind == "pem":
                at = bisect_left(starts, end)
                end = len(text) if at == len(marks) else marks[at].end() if marks[at][0].endswith("KEY-----") else starts[at]
                value = text[m.start() : end]
            if kind != "random" or _random(value):
                out.append((m.start(), k, end, _hash(value)))
    return sorted(out)


def apart(wider: list[tuple], base: list[tuple]) -> list[tuple]:
    """Those of ``wider`` that overlap none of ``base``, which is sorted by start."""
    starts, reach = [x[0] for x in base], list(accumulate((x[2] for x in base), max))
    out = []
    for x in wider:
        before = bisect_left(starts, x[2])  # of those that start before its end, does any reach beyond its start?
        if not before or reach[before - 1] <= x[0]:
            out.append(x)
    return out


def _spell(spans) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


_FOUND = "array<struct<a:int,k:int,b:int,value:binary>>"
SCANNED = f"id long, repo string, owner string, n_assign long, n_access long, n_hex long, base string, found {_FOUND}, hidden array<binary>"


def _scan(batches):
    spans = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32()), ("value", pa.binary())]))
    schema = pa.schema([("id", pa.int64()), ("repo", pa.string()), ("owner", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("found", spans), ("hidden", pa.list_(pa.binary()))])
    for batch in batches:
        n, spelt, found, hidden = [[], [], []], [], [], []
        for t in batch.column("text"):
            text = t.as_py()
            base, wider = base_candidates(text), wider_candidates(text)
            for k in range(len(BASE)):
                n[k].append(sum([x[1] == k for x in base]))
            spelt.append(_spell([x[:3] for x in base]))
            free = apart(wider, base)
            found.append([{"a": a, "k": k, "b": b, "value": v} for a, k, b, v in (*base, *free)])
            # one that overlaps a base span is never reported, but its value counts
            hidden.append(sorted({x[3] for x in wider} - {x[3] for x in free}))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("repo"), batch.column("owner"), *[pa.array(x, pa.int64()) for x in n], pa.array(spelt, pa.string()), pa.array(found, spans), pa.array(hidden, pa.list_(pa.binary()))], schema=schema)


_SPAN = "struct<a:int,k:int,b:int,owners:bigint,repositories:bigint,live:boolean>"


def first_apart(spans: list[dict]) -> list[dict]:
    """Of spans sorted by start, those of base kinds, and of the others the first of those that overlap."""
    out, end = [], 0
    for x in spans:
        if x["k"] < len(BASE):
            out.append(x)
        elif x["a"] >= end:
            out.append(x)
            end = x["b"]
    return out


def _apart_from_each_other(batches):
    span = pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32()), ("owners", pa.int64()), ("repositories", pa.int64()), ("live", pa.bool_())])
    schema = pa.schema([("place", pa.int64()), ("spans", pa.list_(span))])
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("place"), pa.array([first_apart(x.as_py()) for x in b.column("all")], pa.list_(span))], schema=schema)


def _with_counts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` with the ``counts`` of their value.

    A value is common if more than COMMON candidates, and more than one in RATIO of all, have it: there are fewer than RATIO of those, which are
    broadcast, so that a widely copied example meets its counts where it stands.
    """
    often = candidates.groupBy("value").agg(F.count("*").alias("times"))
    most = max(COMMON, (candidates.count()) // RATIO)
    common = cut(often.where(F.col("times") > most).select("value").join(counts, "value"), "common")
    if common.isEmpty():
        return candidates.join(counts, "value")
    rest = candidates.join(F.broadcast(common.select("value")), "value", "left_anti").join(counts, "value")
    return rest.unionByName(candidates.join(F.broadcast(common), "value"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """One row for each row of ``docs``: id, n_assign, n_access, n_hex, base_spans, spans, span_owners, span_repositories, span_live.

    Spans are ``kind:start:end`` by start, then kind as listed, in code points, end exclusive. ``spans`` has the
    base ones and those wider ones whose value at most ``owners`` owners and ``repositories`` repositories hold; the arrays
    after it have, for each of its spans, how many owners and repositories hold its value and whether that is so few. Null
    texts count as empty, a null owner as one owner of its own; repeated rows are reported each. An empty table gives an
    empty result. Only the columns named are read.
    """
    repo = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in repo_cols])
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), repo.alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x02")).alias("owner"))
    scanned = cut(slim.mapInArrow(_scan, SCANNED).withColumn("place", F.monotonically_increasing_id()), "scanned")
    with_any = scanned.where("size(found) > 0")
    candidates = with_any.select("place", F.explode("found").alias("x")).select("place", "x.*")
    every = F.explode(F.concat(F.transform("found", lambda x: x["value"]), "hidden")).alias("value")
    # each owner and repository counts once for a value: a widely copied one shrinks before it meets itself
    held = with_any.select("repo", "owner", every).groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    counts = held.groupBy("value").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repositories"))
    counts = counts.withColumn("live", (F.col("owners") <= owners) & (F.col("repositories") <= repositories))
    # a wider candidate that is an example is gone before overlaps are looked at
    reported = _with_counts(candidates, counts).where((F.col("k") < len(BASE)) | F.col("live"))
    span = F.struct("a", "k", "b", "owners", "repositories", "live")
    lists = reported.groupBy("place").agg(F.array_sort(F.collect_list(span)).alias("all"))
    lists = lists.mapInArrow(_apart_from_each_other, f"place long, spans array<{_SPAN}>")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spelt = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["a"].cast("string"), x["b"].cast("string"))), ",")
    return scanned.join(lists, "place", "left").select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", F.col("base").alias("base_spans"), F.coalesce(spelt, F.lit("")).alias("spans"),
        *[F.coalesce(F.col(f"spans.{c}"), F.array().cast(f"array<{t}>")).alias(f"span_{c}") for c, t in (("owners", "long"), ("repositories", "long"), ("live", "boolean"))],
    )
