"""Sharding, hard negatives and periodic runs against brute force, and their edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from delayspace.llm import hard_negatives as hn
from delayspace.llm import periodic, queries, sharding
from delayspace.llm.hard_negatives import hard_negatives
from delayspace.llm.periodic import periodic_runs, planted
from delayspace.llm.sharding import shard_rows

SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, id string, place long, runs long, rank long").repartition(3)


# sharding


def walked(hashes, shards, points, most):
    """The shard of each hash, one key at a time: rounds of one step, keys in the order of the ring."""
    at, owner = sharding.ring(shards, points)
    place = [int(np.searchsorted(at, h)) for h in hashes]
    order = sorted(range(len(hashes)), key=lambda i: hashes[i])
    now, held, out = [p % len(at) for p in place], Counter(), {}
    while len(out) < len(hashes):
        for i in order:
            if i in out:
                continue
            s = int(owner[now[i]])
            if held[s] < most[s]:
                held[s] += 1
                out[i] = s
            else:
                now[i] = (now[i] + 1) % len(at)
    return [out[i] for i in range(len(hashes))]


@pytest.mark.parametrize("slack", [0.0, 0.2])
def test_sharding_walks_the_ring(spark, slack):
    ids = list(range(0, 3_000, 7))
    rows = [(i, f"text {i}") for i in ids]
    hashes = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.xxhash64("i", F.lit(sharding.SEED))).collect()]
    got = {r["doc_id"]: r for r in shard_rows(docs(spark, rows), 5, points=8, slack=slack).collect()}
    want = walked(hashes, 5, 8, sharding.bounds(len(ids), 5, slack))
    assert [got[i]["shard"] for i in ids] == want
    assert all(got[i]["size"] == len(f"text {i}") + 16 and got[i]["text_crc32"] == zlib.crc32(f"text {i}".encode()) for i in ids)


def test_sharding_balance_slots_and_edges(spark):
    rows = [(i, "same") for i in range(200)] + [(7, "again")] * 300 + [(None, None), (None, ""), (None, "z" * 200_000), (-5, "é"), (9_000, None)]
    got = shard_rows(docs(spark, rows), 6, slack=0.0).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 6
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 9_000} == {(16, 0)}
    again = shard_rows(docs(spark, rows).repartition(2), 6).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert shard_rows(docs(spark, rows[:0]), 6).collect() == []
    assert [r["slot"] for r in shard_rows(docs(spark, rows[:1]), 6).collect()] == [0]
    with pytest.raises(ValueError):
        shard_rows(docs(spark, rows), 0)


def test_sharding_moves_little(spark):
    """A further shard moves about its share of the rows, and what the bounds push on; a remainder would move nearly all."""
    df = docs(spark, [(i, "t") for i in range(20_000)])
    of = lambda n: {r["doc_id"]: r["shard"] for r in shard_rows(df, n, slack=0.25).collect()}
    a, b = of(20), of(21)
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert 0.02 < moved < 0.12
    assert max(Counter(b.values()).values()) <= np.ceil(1.25 * 20_000 / 21)


def test_sharding_query(spark):
    n = pq.read_table(f"{SF}/documents.parquet").num_rows
    got = queries.op11_sharding(spark, SF).toPandas()
    assert len(got) == n and set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    counts = got["shard"].value_counts().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1


# hard negatives


def brute_negatives(rows, positives=5, k=3, factor=256):
    """rows: (id, label, vector, is_anchor)."""
    use, seen = [], set()
    for i, label, v, anchor in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = tuple(int(np.floor(np.float64(factor) * np.float64(x))) for x in v)
        if (i, label, v) not in seen:
            seen.add((i, label, v))
            use.append((i, label, v, anchor))
    out = []
    for i, label, v, anchor in use:
        if not anchor:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), j, own) for j, own, w, _ in use if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for p, j, own in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:k]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, label int, embedding array<float>, anchor boolean, no long, v string").repartition(3)
    got = hard_negatives(df, F.col("anchor"), **how).collect()
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got)


def vectors(rng, n, d=6, labels=4, spread=1.0):
    return [(int(i), int(rng.integers(labels)), [float(np.float32(x)) for x in rng.normal(0.4, spread, d)], i % 5 == 0) for i in range(n)]


def test_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_TILES", 6)
    rng = np.random.default_rng(3)
    rows = vectors(rng, 300)
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 60, spread=0.3)
    one = rows[0][2]
    rows += [(100 + i, i % 3, one, i % 10 == 0) for i in range(90)]  # one vector in many rows: all scores tie
    rows += [rows[5], rows[5], (7, 2, one, False), (None, 1, one, True), (500, None, one, True), (501, 1, None, True), (502, 1, [], True), (503, 1, [None, 1.0], True), (504, 1, [float("nan")] * 6, True), (505, 1, [float("inf")] * 6, False), (506, 1, [1.0, 2.0], True), (507, 1, [1.0, 2.5], False), (508, 2, [0.9, 1.5], False), (509, 1, [0.0] * 6, True)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, rows[:0]) == Counter()
    assert mined(spark, rows[:1]) == Counter()


def test_negatives_with_large_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, label, [float(np.float32(x * 2e6)) for x in v], a) for i, label, v, a in vectors(rng, 80)]
    want = brute_negatives(rows)
    assert max(x[4] for x in want) > 1 << 52 and mined(spark, rows) == want
    assert hn.scores(np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 1.0]])).tolist() == [[hn.HIGHEST]]


def test_radix_passes_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = vectors(rng, 120)
    want = brute_negatives(rows)
    for digit in (3, 16):
        monkeypatch.setattr(hn, "DIGIT", digit)
        assert mined(spark, rows) == want


# periodic runs


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    period = lambda a, b: next(q for q in range(1, b - a + 1) if all(w[i] == w[i + q] for i in range(a, b - q)))
    for a in range(n):
        for b in range(a + least, n + 1):
            for q in range(1, (b - a) // times + 1):
                if all(w[i] == w[i + q] for i in range(a, b - q)):
                    if b - a >= max(least, times * q) and period(a, b) == q and (a == 0 or w[a - 1] != w[a - 1 + q]) and (b == n or w[b] != w[b - q]):
                        out.append((a, b - a, q))
                    break
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def brute_answer(w, runs):
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return best, " ".join(x for i, x in enumerate(w) if i not in drop)


def random_words(rng, n):
    w = []
    while len(w) < n:
        if rng.random() < 0.4:
            w += [str(x) for x in rng.integers(0, 3, rng.integers(1, 4))] * int(rng.integers(1, 8))
        else:
            w += [str(x) for x in rng.integers(0, 3, rng.integers(1, 6))]
    return w[:n]


@pytest.mark.parametrize("work", [periodic.WORK, 150])
def test_runs_against_brute_force(spark, work):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(random_words(rng, int(rng.integers(0, 45))))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "a " * 9), (903, "a b " * 30), (903, "a b " * 30), (904, "a b " * 12), (905, "\n".join(["x y z"] * 4))]
    got = periodic_runs(docs(spark, rows), work=work).collect()
    said = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["best"] and tuple(r["best"]), r["collapsed"]) for r in got)
    want = Counter()
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(w)
        best, rest = brute_answer(w, runs)
        want[(i, tuple(runs), best, rest)] += 1
    assert said == want


def test_runs_of_very_long_texts(spark):
    long_ = "w " * 60_000  # one run, met again at every lag
    odd = " ".join(str(i % 997) if i % 5_000 else "x" for i in range(120_000))
    got = {r["doc_id"]: r for r in periodic_runs(docs(spark, [(1, long_), (2, odd)]), work=1 << 26).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 60_000, 1)] and got[1]["collapsed"] == "w"
    assert [x["period"] for x in got[2]["runs"]] == [997] * len(got[2]["runs"]) and len(got[2]["runs"]) == 24
    assert periodic_runs(docs(spark, [(1, "a")]).where("false")).collect() == []


def test_runs_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = {r["doc_id"]: r for r in queries.op13_periodic(spark, SF).collect()}
    assert len(got) == len(t["doc_id"])
    n_planted = 0
    for i, text in zip(t["doc_id"], t["text"], strict=True):
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
            n_planted += 1
        runs = periodic.runs_of(periodic.lag_runs(periodic.numbered([x.encode() for x in w]), range(1, n // 4 + 1)))
        if n <= 60:
            assert runs == brute_runs(w)
        best, rest = brute_answer(w, runs)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (None if best is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(rest.encode()).hexdigest()
    assert n_planted > 5


def test_planting_leaves_null_ids(spark):
    got = planted(docs(spark, [(None, "a b c"), (None, None)])).collect()
    assert sorted(r["text"] or "" for r in got) == ["", "a b c"]
