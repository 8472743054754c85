"""Exact dedup, suffix-array dedup and SimHash against brute force, and their edge cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from delayspace.llm import simhash
from delayspace.llm.exact_dedup import drop_exact_copies, exact_dedup
from delayspace.llm.graph import connected_components
from delayspace.llm.simhash import Forest, deal, drop_near_copies, fingerprint, grow, near_classes, shard_links, similar_classes
from delayspace.llm.suffix_dedup import common_prefixes, merged, repeated_bytes, shared_strings, snippets, two_stage_suffix_array

SCHEMA = "doc_id long, text string, fp string, keep_id string, run long, id string, th string"
LONG = " ".join(f"word{i}" for i in range(40_000))


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "a", None, 1, "b", "c") for i, t in rows], SCHEMA).repartition(3)


EDGE = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, " "), (6, "a\tb"), (7, LONG), (8, LONG), (8, LONG), (None, "a b"), (None, "z"), (9, "a b "), (9, "a\nb ")]


def test_exact(spark):
    got = [tuple(r) for r in exact_dedup(frame(spark, EDGE)).collect()]
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in EDGE:
        groups[norm(t)].append(i)
    want = []
    for i, t in EDGE:
        ids = [x for x in groups[norm(t)] if x is not None]
        want.append((i, min(ids) if ids else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=key) == sorted(want, key=key)
    assert sum(r[3] for r in got) == len(groups)
    assert exact_dedup(frame(spark, [])).count() == 0
    kept = drop_exact_copies(frame(spark, EDGE))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(groups)


def test_exact_over_many_runs(spark):
    rows = [(i, f"t{i % 37}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40, "doc_id")
    got = exact_dedup(df, fan_in=3).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {i: i % 37 for i, _ in rows}
    assert all(r["group_size"] == len(range(r["doc_id"] % 37, 600, 37)) for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 97, 255, 256]), min_size=1, max_size=120))
def test_suffix_array(values):
    data = np.array(values, np.uint16)
    want = sorted(range(len(values)), key=lambda i: values[i:])
    got = two_stage_suffix_array(data, depth=140)
    assert got.tolist() == want
    pref = [0]
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while n < 15 and max(a, b) + n < len(values) and values[a + n] == values[b + n]:
            n += 1
        pref.append(n)
    assert common_prefixes(data, got, 15).tolist() == pref


def brute_spans(rows, width):
    first = {}
    for i, t in sorted([r for r in rows if r[0] is not None], key=lambda r: r[0]):
        data = (t or "").encode()
        for s in range(len(data) - width + 1):
            first.setdefault(data[s : s + width], i)
    out = []
    for i, t in rows:
        data, spans = (t or "").encode(), []
        for s in range(len(data) - width + 1 if i is not None else 0):
            if first[data[s : s + width]] < i:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + width
                else:
                    spans.append([s, s + width])
        out.append((i, len(data), [a for a, _ in spans], [b for _, b in spans]))
    return out


def test_repeated_bytes(spark):
    rng = np.random.default_rng(5)
    passages = ["".join(rng.choice(list("abé \n"), rng.integers(40, 90))) for _ in range(6)]
    rows = [(int(i), "".join(rng.choice(list("xyz é"), rng.integers(0, 60))) + "".join(rng.choice(passages, rng.integers(0, 4))) + "".join(rng.choice(list("xyz"), rng.integers(0, 30)))) for i in rng.permutation(60)]
    rows += [(100, None), (101, ""), (102, LONG[:5_000]), (103, "q" + LONG[10:4_000]), (102, LONG[:5_000]), (None, passages[0]), (104, "ab" * 300), (105, "ab" * 40)]
    got = repeated_bytes(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r[0], r[1], list(r[2]), list(r[3])) for r in got], key=key) == sorted(brute_spans(rows, 50), key=key)
    for r in got:
        text = next((t or "") for i, t in rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        data, kept, at = text.encode(), b"", 0
        for a, b in zip(r["a"], r["b"], strict=True):
            kept, at = kept + data[at:a], b
        assert bytes(r["kept"]) == kept + data[at:]
    wide = sorted([(r[0] is None, r[0] or 0, r[1], list(r[2]), list(r[3])) for r in repeated_bytes(frame(spark, rows), width=75).collect()])
    assert wide == sorted([(i is None, i or 0, n, a, b) for i, n, a, b in brute_spans(rows, 75)])
    with pytest.raises(ValueError):
        repeated_bytes(frame(spark, rows), width=300)
    assert repeated_bytes(frame(spark, [])).count() == 0


def test_shared_strings_and_snippets():
    parts, doc = [b"abcabcabcabc", b"xxabcabcab", b"abcabcabcabc"], np.array([2, 1, 1])
    hits = shared_strings(parts, doc, 6)
    has = {p[s : s + 6]: min(d for q, d in zip(parts, doc, strict=True) if p[s : s + 6] in q) for p in parts for s in range(len(p) - 5)}
    assert [h.tolist() for h in hits] == [[bool(d > has[p[s : s + 6]]) for s in range(len(p) - 5)] for p, d in zip(parts, doc, strict=True)]
    data = np.frombuffer(LONG.encode()[:3_000], np.uint8)
    _, _, first, many = snippets(data, np.repeat([0, 1], 1_500))
    assert sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(first, many, strict=True)]).tolist()) == [s for s in range(2_951) if s <= 1_450 or s >= 1_500]
    assert [x.tolist() for x in merged(np.array([5, 1, 7, 20]), np.array([6, 3, 9, 22]))] == [[1, 5, 7, 20], [3, 6, 9, 22]]


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", "  ", "One", "one TWO three", "a b c d", "É Ü ß A b C d", "the cat sat on the mat " * 20, LONG[:3_000]):
        assert fingerprint(t) == brute_fingerprint(t)


def test_shards_and_trees_find_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 3_000, dtype=np.uint64)
    near = base[rng.integers(0, 3_000, 2_000)]
    for _ in range(5):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64))
    hub = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate((base, near, hub)))
    brute = Forest(len(fps))
    for at in range(0, len(fps), 500):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None]) <= 4)
        brute.join(i + at, j)
    want = brute.roots(np.arange(len(fps)))
    assert (shard_links(fps, np.ones(len(fps), bool), 4, leaf=40) == want).all()
    rows, shard, resident = deal(grow(fps[::3], 4), fps, 4)
    assert np.bincount(rows[resident], minlength=len(fps)).max() == 1 and resident.sum() == len(fps)
    tied = Forest(len(fps))
    for s in range(shard.max() + 1):
        here = rows[shard == s]
        tied.join(here, here[shard_links(fps[here], resident[shard == s], 4)])
    assert (tied.roots(np.arange(len(fps))) == want).all()


def test_near_classes(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here " * 12
    rows = [(5, base), (3, base.upper()), (9, base + "end"), (4, None), (2, ""), (8, LONG), (7, LONG), (None, base), (6, "alone in the world")]
    got = near_classes(frame(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    ids = [i for i, _ in rows if i is not None]
    least = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = [y for y in ids if y not in seen and bin(fps[x] ^ fps[y]).count("1") <= 4]
            seen |= {*new}
            todo += new
        least[i] = min(seen)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == least
    assert all(r["fingerprint"] == f"{fps[r['doc_id']]:016x}" for r in got)
    assert near_classes(frame(spark, [])).count() == 0


def test_similar_classes(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5_000, 300)) for _ in range(6)]
    edited = texts[0].split()
    edited[100:102] = ["new", "words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, " ".join(edited)), (11, texts[3]), (12, None), (13, ""), (None, texts[1]), (14, LONG)]
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 10: 0, 11: 3, 12: 12, 13: 12, 14: 14}
    kept = drop_near_copies(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 12, 14]
    assert kept.columns == frame(spark, []).columns
    assert drop_near_copies(frame(spark, [])).count() == 0
    # an id that stands for two texts, of which one is a near copy; rows that repeat id and text; rows without an id
    rows = [(3, texts[0]), (5, " ".join(edited)), (5, texts[1]), (6, texts[2]), (6, texts[2]), (None, texts[2]), (None, texts[4])]
    kept = sorted([(r["doc_id"] or 0, r["text"]) for r in drop_near_copies(frame(spark, rows)).collect()])
    assert kept == sorted([(3, texts[0]), (5, texts[1]), (6, texts[2]), (0, texts[4])])


def test_similar_classes_are_exact(spark):
    """Links by the true Jaccard similarity of five-word shingles, short texts and dense groups included."""
    rng = np.random.default_rng(8)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    texts = []
    for n in (9, 12, 30, 60, 150):
        for _ in range(12):
            base = words(n)
            texts.append(base)
            texts += [base[:-k] for k in (1, 2) if n > 8] + [base[: n - n // c] for c in (4, 5, 6)]
            for edits in (1, 2, 3, 4):
                other = list(base)
                for at in rng.choice(n, edits, replace=False):
                    other[at] = f"x{rng.integers(0, 10**9)}"
                texts.append(other)
    dense = words(80)
    for _ in range(60):
        other = list(dense)
        other[int(rng.integers(5, 75))] = f"y{rng.integers(0, 10**9)}"
        texts.append(other)
    texts.append(dense)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(frame(spark, rows)).collect()}
    assert got == {i: root(i) for i in range(len(rows))}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1_000, k) for k in range(1_001, 1_100)] + [(2_000 + k, 2_001 + k) for k in range(40)] + [(None, 3), (4, None), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub(spark):
    """A star of 100,000 leaves, its centre in the middle of their numbers, and a chain beside it."""
    star = spark.range(100_000).where("id <> 50000").select(F.col("id").alias("a"), F.lit(50_000).cast("long").alias("b"))
    chain = spark.range(200_000, 200_050).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(star.union(chain)).groupBy("component").count().collect()
    assert {r["component"]: r["count"] for r in got} == {0: 100_000, 200_000: 51}


def test_candidates_of_a_large_group_grow_with_its_members():
    """However the sorted rows are cut into batches, a group gives the same candidates, and twice the members twice as many."""
    rng = np.random.default_rng(4)

    def candidates(n, batches):
        size = np.sort(rng.integers(90, 110, n)) if n > 40 else np.full(n, 100)
        token = np.concatenate((np.zeros(n, np.int64), np.repeat(np.arange(1, 40), 2)))
        node, place = rng.permutation(len(token)).astype(np.int64), np.concatenate((size, np.full(78, 100))).astype(np.int64) << 32
        rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (token, node, place)], names=["token", "node", "place"])
        cuts = np.unique(np.concatenate(([0], rng.integers(0, len(token), batches - 1), [len(token)])))
        got = set()
        for parts in ([rows], [rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]):
            found = {tuple(p) for out in simhash._near_pairs(0.8)(iter(parts)) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)}
            assert not got or found == got
            got = found
        return len(got) - 39

    assert candidates(12, 5) == 66
    assert candidates(4_000, 9) == 120 + 4 * (4_000 - 16) and candidates(8_000, 30) == 120 + 4 * (8_000 - 16)


def test_groups_that_stay_apart_meet_pair_by_pair():
    token, part = np.repeat([1, 2, 3], [5, 1, 4]), np.array([1, 1, 2, 3, 3, 9, 7, 7, 8, 8])
    node, place = np.arange(10), np.full(10, 100 << 32)
    sketches = pa.array([b""] * 9 + [bytes([0, 0, 0, 1] * 4)], pa.binary())
    rows = pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int64)) for x in (token, node, place, part)], sketches], names=["token", "node", "place", "part", "sketch"])
    pairs = lambda best: {tuple(p) for out in simhash._apart_pairs(0.8, best)(iter([rows.slice(0, 3), rows.slice(3, 4), rows.slice(7)])) for p in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert pairs(False) == {(0, 2), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (6, 8), (6, 9), (7, 8), (7, 9)}
    assert pairs(True) < pairs(False) and {x for p in pairs(True) for x in p} == {0, 1, 2, 3, 4, 6, 7, 8, 9}


def test_overlaps_of_sketches():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (5, 40, 40, 300, 1_000)]
    sets.append(np.unique(np.concatenate((sets[3], sets[1]))))
    sketches = [simhash.sketch(x) for x in sets]
    for x, own in zip(sketches, sets, strict=True):
        for got, other, y in zip(simhash.overlaps(x, sketches), sets, sketches, strict=True):
            a, b = (np.frombuffer(z, np.uint8).astype(int) for z in (x, y))
            n = min(len(a), len(b))
            assert got == np.minimum(a.reshape(n, -1).sum(axis=1), b.reshape(n, -1).sum(axis=1)).sum() >= len(np.intersect1d(own, other))
    assert simhash.overlaps(b"", sketches[:2]).min() > 1 << 60


def test_near_copies_beyond_the_broadcast(spark, monkeypatch):
    """Counted shingles, small groups of counting and joins by shuffle give what the sample's order and broadcasts give."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    base = [[words[j] for j in rng.integers(0, 400, 120)] for _ in range(40)]
    rows = []
    for i in range(240):
        w = list(base[i % 40])
        w[int(rng.integers(120))] = "other"
        rows.append((i, " ".join(w)))
    want = sorted(map(tuple, similar_classes(frame(spark, rows)).collect()))
    assert len({c for _, c in want}) == 40
    monkeypatch.setattr(simhash, "COMMON_SAMPLE", 3)
    monkeypatch.setattr(simhash, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(simhash, "COUNTED", 500)
    monkeypatch.setattr(simhash, "DEALT", 1_000)
    assert sorted(map(tuple, similar_classes(frame(spark, rows)).collect())) == want


def test_near_copies_are_found_by_the_tree(spark, monkeypatch):
    """Links of similar texts come from fingerprints in the vantage-point tree; shingles that meet add what balls miss, and are not needed for close copies."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        for edit in range(3):
            rows.append((3 * k + edit, " ".join([*words[: 50 * edit], "other", *words[50 * edit :]])))

    def nothing(*_):
        def run(batches):
            for b in batches:
                yield b.select(["token", "node"]).slice(0, 0).rename_columns(["a", "b"])

        return run

    monkeypatch.setattr(simhash, "_near_pairs", nothing)
    got = {r["doc_id"]: r["component_id"] for r in similar_classes(frame(spark, rows)).collect()}
    assert got == {i: i - i % 3 for i in range(180)}


def test_spanning_pairs_of_a_shard(spark):
    rng = np.random.default_rng(13)
    centres = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (12, 5), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for c in centres]))
    nodes = [(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))] + [(10_000, int(fps.view(np.int64)[3]))]
    pairs = simhash._ball_pairs(spark.createDataFrame(nodes, "node long, fp long"), 10).collect()
    of = dict(nodes)
    bits = lambda a, b: bin((of[a] ^ of[b]) & (1 << 64) - 1).count("1")
    assert all(r["a"] < r["b"] and bits(r["a"], r["b"]) <= 10 for r in pairs)
    got, want = Forest(10_001), Forest(10_001)
    got.join(np.array([r["a"] for r in pairs]), np.array([r["b"] for r in pairs]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 10)
    want.join(np.append(i, 3), np.append(j, 10_000))
    assert (got.roots(np.arange(10_001)) == want.roots(np.arange(10_001))).all()
    assert len(pairs) < 5 * len(fps)
