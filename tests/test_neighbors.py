"""Indexed and tiled neighbour searches against brute force."""

import numpy as np
import pytest

from delayspace.functions.boxes import Boxes, boxed_nearest
from delayspace.functions.kernels import nearest
from delayspace.operators import neighbors as nb


def states(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        return rng.random((n, 3))
    if kind == "discrete":
        return rng.integers(0, 4, (n, 3)).astype(float)
    if kind == "constant":
        out = np.zeros((n, 3))
        out[::50] = 1
        return out
    x = np.cumsum(rng.normal(size=n + 2))
    return np.column_stack([x[2:], x[1:-1], x[:-2]])


@pytest.mark.parametrize("kind", ["uniform", "discrete", "constant", "walk"])
@pytest.mark.parametrize("radius", [0, 5, 400])
def test_boxes_find_what_a_full_search_finds(kind, radius):
    lib, rows = states(kind, 3_000), np.arange(1, 3_001)
    want = nearest(rows[::4], lib[::4], rows, lib, 4, radius)
    got = boxed_nearest(rows[::4], lib[::4], rows, lib, 4, radius)
    assert all((a == b).all() for a, b in zip(want, got[:3], strict=True))
    if radius < 400:
        assert got[3] < 0.15 * 750 * 3_000


def test_bounds_of_boxes():
    lib, rows = states("walk", 2_000), np.arange(2_000)
    tree = Boxes.grow(lib[::7], rows[::7], 4)
    tree.fit_rows(tree.leaf(lib, rows), lib, rows)
    d = np.sort(np.sqrt(((lib[:50, None] - lib[None]) ** 2).sum(axis=2)), axis=1)
    for wanted in (1, 30, 2_000):
        assert (tree.bound(lib[:50], wanted) >= d[:, wanted - 1]).all()
    assert np.isinf(tree.bound(lib[:50], 2_001)).all()


def frames(spark, lib, rows, asked):
    left = spark.createDataFrame([(int(rows[i]), *map(float, lib[i])) for i in asked], "p long, a0 double, a1 double, a2 double").repartition(3)
    right = spark.createDataFrame([(int(r), *map(float, v), float(r) / 2, f"t{r}") for r, v in zip(rows, lib, strict=True)], "l long, b0 double, b1 double, b2 double, y double, tag string").repartition(3)
    return left, right


@pytest.mark.parametrize(("kind", "radius"), [("uniform", 0), ("discrete", 3), ("constant", 0), ("walk", 40)])
def test_index_finds_what_a_full_search_finds(spark, monkeypatch, kind, radius):
    monkeypatch.setattr(nb, "CELL", 256)
    monkeypatch.setattr(nb, "PART", 100)
    lib, rows = states(kind, 6_000, 1), np.arange(1, 6_001)
    asked = list(range(0, 6_000, 5))
    left, right = frames(spark, lib, rows, asked)
    counted = spark.sparkContext.accumulator(0)
    got = nb.indexed_neighbors(left, right, 3, 4, radius, len(asked), 6_000, ["y", "tag"], counted).collect()
    i, j, d = nearest(rows[asked], lib[asked], rows, lib, 4, radius)
    rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
    assert {(r["p"], r["rank"]): (r["l"], r["d"], r["y"], r["tag"]) for r in got} == {(int(rows[asked][a]), int(k)): (int(rows[b]), float(x), rows[b] / 2, f"t{rows[b]}") for a, b, x, k in zip(i, j, d, rank, strict=True)}
    assert 0 < counted.value < 0.25 * len(asked) * 6_000


def test_search_picks_its_way(spark, monkeypatch):
    """Beyond the limits of the theta join an index or tiles give the same; balls that reach most cells are left to tiles."""
    lib, rows = states("uniform", 2_000, 2), np.arange(1, 2_001)
    left, right = frames(spark, lib, rows, range(0, 2_000, 9))
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(nb.neighbors(left, right, 3, 3, 2, 223, 2_000, carry=["y"]))
    monkeypatch.setattr(nb, "PAIRS", 1_000)
    monkeypatch.setattr(nb, "TILE", 700)
    assert show(nb.neighbors(left, right, 3, 3, 2, 223, 2_000, carry=["y"])) == want
    monkeypatch.setattr(nb, "CELL", 128)
    assert show(nb.neighbors(left, right, 3, 3, 2, 223, 2_000, carry=["y"])) == want
    monkeypatch.setattr(nb, "REACH", 0.0)
    assert show(nb.neighbors(left, right, 3, 3, 2, 223, 2_000, carry=["y"])) == want


def test_panel_of_long_and_short_series(spark, monkeypatch):
    """A long series in tiles and short ones packed give what a search of each series gives."""
    rng = np.random.default_rng(7)
    left, right, want = [], [], {}
    for name, n in [("long", 900), *[(f"s{i}", int(rng.integers(1, 40))) for i in range(60)], ("one", 1)]:
        lib, rows = rng.integers(0, 6, (n, 2)).astype(float), np.arange(1, n + 1)
        left += [(name, 0, int(r), *map(float, v)) for r, v in zip(rows, lib, strict=True)]
        right += [(name, 0, int(r), *map(float, v), float(r)) for r, v in zip(rows, lib, strict=True)]
        i, j, d = nearest(rows, lib, rows, lib, 3, 2)
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        want |= {(name, int(rows[a]), int(r)): (int(rows[b]), float(x), float(rows[b])) for a, b, x, r in zip(i, j, d, rank, strict=True)}
    left.append((None, 0, 1, 1.0, 1.0))
    pred = spark.createDataFrame(left, "g string, h int, p long, a0 double, a1 double").repartition(3)
    lib = spark.createDataFrame(right, "g string, h int, l long, b0 double, b1 double, y double").repartition(3)
    show = lambda df: {(r["g"], r["p"], r["rank"]): (r["l"], r["d"], r["y"]) for r in df.collect()}
    assert show(nb.neighbors(pred, lib, 2, 3, 2, keys=["g", "h"], carry=["y"])) == want
    monkeypatch.setattr(nb, "PAIRS", 1_000)
    sizes = lambda: pred.groupBy("g", "h").count().withColumnRenamed("count", "_p").join(lib.groupBy("g", "h").count().withColumnRenamed("count", "_l"), ["g", "h"])
    assert show(nb.neighbors(pred, lib, 2, 3, 2, keys=["g", "h"], carry=["y"])) == want
    assert show(nb.panel_neighbors(pred, lib, 2, 3, 2, ["g", "h"], sizes(), ["y"], tile=100)) == want


def test_shuffle_by_ranges(spark, monkeypatch):
    from delayspace.operators import surrogate
    from delayspace.sources.series import load

    s = load(spark.createDataFrame([(i, float(i * i % 17)) for i in range(200)], "t long, x double"))
    want = sorted(map(tuple, surrogate.surrogate_data(s, "x", num_surr=3, seed=4).collect()))
    monkeypatch.setattr(surrogate, "ONE_TASK", 50)
    assert sorted(map(tuple, surrogate.surrogate_data(s, "x", num_surr=3, seed=4).collect())) == want


@pytest.mark.parametrize("kind", ["normal", "copies", "far", "tied", "huge"])
@pytest.mark.parametrize("radius", [0, 7])
def test_screened_distances_lose_no_neighbour(kind, radius):
    from delayspace.functions import kernels

    rng = np.random.default_rng(3)
    lib = rng.integers(0, 2, (3_001, 12)).astype(float) if kind == "tied" else rng.normal(size=(3_001, 64)).astype(np.float32).astype(float)
    lib = {"copies": lambda: np.concatenate((lib[:1_500], lib[:1_501])), "far": lambda: lib + 1e6, "huge": lambda: lib * 1e200}.get(kind, lambda: lib)()
    rows, own = np.arange(1, 3_002), slice(50, 250)
    gap = np.abs(rows[own, None] - rows[None])
    with np.errstate(over="ignore"):
        d = np.where(gap > radius, kernels.distances(lib[own], lib), np.inf)
        i, j, got = nearest(rows[own], lib[own], rows, lib, 5, radius)
    want = [[(d[r, c], c) for c in np.lexsort((rows, gap[r], d[r]))[:5] if d[r, c] < np.inf] for r in range(200)]
    assert [(x, c) for row in want for x, c in row] == list(zip(got, j, strict=True))
    assert i.tolist() == [r for r, row in enumerate(want) for _ in row]
    found = kernels.screened(rows[own], lib[own], rows, lib, 5, radius)
    assert found is None if kind == "huge" else len(found[0]) < 0.05 * gap.size


def test_tiles_of_numbered_rows_go_to_many_tasks(spark, monkeypatch):
    """A window leaves rows in one partition, which would do for all tiles at once."""
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    monkeypatch.setattr(nb, "TILE", 100)
    base = spark.range(0, 600, 1, 1).withColumn("r", F.row_number().over(W.orderBy("id")).cast("long"))
    vector = lambda side: [(F.xxhash64(F.lit(k), "id") % 1_000).cast("double").alias(f"{side}{k}") for k in range(14)]
    sc = spark.sparkContext
    sc.setJobGroup("tiles", "tiles")
    try:
        got = nb.tiled_neighbors(base.select(F.col("r").alias("p"), *vector("a")), base.select(F.col("r").alias("l"), *vector("b")), 14, 3, 0, 600, 600).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 1_800
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("tiles") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) == 36
