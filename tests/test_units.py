"""Operators of the library one by one: edges, names, errors, equal results by either plan."""

import datetime
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import delayspace as ds
from delayspace.functions.args import expand_pairs, flatten_to_string, parse_pairs, split_columns
from delayspace.functions.kernels import nearest
from delayspace.operators import neighbors as nb
from delayspace.operators.ccm import library_sizes
from delayspace.operators.surrogate import cycle_of, phase_randomised, smoothing_spline, wide
from delayspace.plans.index import create_indices
from delayspace.sources import series as sr


def line(spark, n=10, **columns):
    rows = [(i + 1, float(i), *[c[i] for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "t int, x double" + "".join(f", `{c}` double" for c in columns))


def points(spark, values, first, name):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], f"{first} long, {name}0 double")


def test_arguments():
    assert split_columns("a b") == ["a", "b"] and split_columns(["a b", "c"]) == ["a b", "c"]
    assert parse_pairs("1 4 7 9") == [(1, 4), (7, 9)] == parse_pairs([(1, 4), (7, 9)]) == parse_pairs((1, 4, 7, 9))
    assert expand_pairs("1 3 5 5") == [1, 2, 3, 5]
    for bad in ("1 2 3", "a b", "", [1.5, 2]):
        with pytest.raises(ValueError):
            parse_pairs(bad)
    for bad in ("0 3", "4 2"):
        with pytest.raises(ValueError):
            expand_pairs(bad)
    assert flatten_to_string([1, ["a", (2, 3)]], "-") == "1-a-2-3" and flatten_to_string("x") == "x"
    assert library_sizes("10 30 5", 40) == [10, 15, 20, 25, 30] and library_sizes([10, 20, 40], 40) == [10, 20, 40]
    with pytest.raises(ValueError):
        library_sizes([50], 40)


def test_indices():
    ix = create_indices("1 40 50 130", "80 170", 2, -3, 1, False, 200)
    assert ix.lib == [(4, 40), (53, 129)] and ix.pred == [(80, 170)]
    assert create_indices("1 20", "1 20", 3, 2, 2, False, 20).lib == [(1, 14)] and create_indices("1 20", "1 20", 3, 2, 0, False, 20).pred == [(1, 16)]
    assert create_indices("1 20", "1 20", 3, -1, -2, False, 20).lib == [(4, 20)]
    assert create_indices("1 20", "1 20", 3, -1, 1, True, 20).lib == [(1, 19)]
    for lib, pred in (("5 5", "1 9"), ("0 5", "1 9"), ("1 30", "1 9"), ("1 9", "1 30"), ("1 3", "1 9")):
        with pytest.raises(ValueError):
            create_indices(lib, pred, 4, -1, 1, False, 20)


@pytest.mark.parametrize("small", [True, False])
def test_neighbours(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(nb, "PAIRS", 0)
        monkeypatch.setattr(nb, "TILE", 3)
    lib, pred = points(spark, range(10), "l", "b"), points(spark, range(10), "p", "a")
    find = lambda k, r: {(x.p, x.rank): (x.l, x.d) for x in nb.neighbors(pred, lib, 1, k, r, 10, 10).collect()}
    near = find(2, 0)
    assert near[(1, 1)] == (2, 1.0) and near[(1, 2)] == (3, 2.0)
    assert near[(5, 1)] == (4, 1.0) and near[(5, 2)] == (6, 1.0)  # a tie goes to the smaller row
    far = find(3, 4)
    assert far[(1, 1)] == (6, 5.0) and sum(p == 5 for p, _ in far) == 1 and far[(5, 1)] == (10, 5.0)
    assert find(3, 9) == {}
    assert max(r for _, r in find(20, 0)) == 9


def test_kernel_equals_brute():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (30, 2)).astype(float), rng.integers(0, 4, (40, 2)).astype(float)
    i, j, d = nearest(np.arange(30), a, np.arange(40), b, 5, 2)
    for p in range(30):
        want = sorted((math.dist(a[p], b[q]), abs(p - q), q) for q in range(40) if abs(p - q) > 2)[:5]
        assert [(x, q) for x, q in zip(d[i == p], j[i == p], strict=True)] == [(w[0], w[2]) for w in want]


def test_embed(spark, tmp_path):
    df = line(spark, 5)
    e = ds.embed(df, E=3, columns="x")
    assert e.columns == ["x(t-0)", "x(t-1)", "x(t-2)"]
    assert [tuple(r) for r in e.collect()] == [(0, None, None), (1, 0, None), (2, 1, 0), (3, 2, 1), (4, 3, 2)]
    assert ds.embed(df, E=3, tau=-2, columns="x").columns == ["x(t-0)", "x(t-2)", "x(t-4)"]
    assert ds.embed(df, E=2, tau=1, columns="x", includeTime=True).columns == ["t", "x(t+0)", "x(t+1)"]
    assert ds.embed(df, E=2, tau=1, columns="x").collect()[-1][1] is None
    assert ds.embed(df, E=2, plusminus=True).columns == ["t", "x", "x(t-1)", "x(t+1)"]
    for bad in (dict(E=0, columns="x"), dict(E=2, tau=0, columns="x"), dict(E=2, columns="z"), dict(E=2)):
        with pytest.raises(ValueError):
            ds.embed(df, **bad)
    df.coalesce(1).write.csv(str(tmp_path / "in.csv"), header=True)
    again = ds.embed(None, E=3, columns="x", pathIn=str(tmp_path), dataFile="in.csv", spark=spark)
    assert again.collect() == e.collect()


def test_shifts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sr, "BLOCK", 7)
    monkeypatch.setattr(sr, "ONE_TASK", 10)
    df = spark.createDataFrame([(float(i), float(i * i)) for i in np.random.default_rng(0).permutation(50)], "t double, x double").repartition(5)
    s = sr.load(df)
    assert s.n == 50 and [r["t"] for r in s.df.orderBy("row_id").collect()] == [float(i) for i in range(50)]
    got = sr.shifted(s.df, s.n, {"a": ("x", -3), "b": ("x", 2)}).orderBy("row_id").collect()
    assert len(got) == 50
    for r in got:
        i = r["row_id"] - 1
        assert r["a"] == ((i - 3) ** 2 if i >= 3 else None) and r["b"] == ((i + 2) ** 2 if i < 48 else None)


def test_panel_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.integers(0, 50)) + i / 1000) for k, n in (("a", 60), ("b", 25), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t int, x double").repartition(6)
    run = lambda: sorted((str(r[0]), *r[1:]) for r in ds.panel_simplex(df, ["k"], "t", "x", "x", (1, 15), (16, 55), E=2).collect())
    whole = run()
    monkeypatch.setattr(sr, "BLOCK", 7)
    monkeypatch.setattr(sr, "ONE_TASK", 10)
    assert run() == whole and len({r[0] for r in whole if r[3] is not None}) >= 2
    one = ds.simplex(df.where("k = 'a'").select("t", "x"), "x", "x", (1, 15), (16, 55), E=2).collect()
    mine = [r[3] for r in whole if r[0] == "a"]
    assert [round(v["Predictions"], 9) for v in one[1:]] == [round(v, 9) for v in mine]


def test_validation(spark):
    df = line(spark, 10)
    text = df.withColumn("s", F.lit("a"))
    for call in (lambda: ds.simplex(text, "x", "x", (1, 5), (6, 9), E=2), lambda: ds.simplex(df, "z", "x", (1, 5), (6, 9), E=2), lambda: ds.simplex(df, "x", "z", (1, 5), (6, 9), E=2), lambda: ds.simplex(df, "x", "x", (1, 5), (6, 9)), lambda: ds.simplex(df.where("t < 0"), "x", "x", (1, 5), (6, 9), E=1), lambda: ds.smap(text, "x", "x", (1, 5), (6, 9), E=2), lambda: ds.simplex(df, "x", "x", (1, 8), (6, 9), E=1, validLib=[False] * 10)):
        with pytest.raises(ValueError):
            call()
    two = line(spark, 30, y=[float(v * v % 7) for v in range(30)])
    with pytest.raises(ValueError):
        ds.smap(two, "x y", "x", (1, 20), (21, 29), E=2)
    holed = two.withColumn("x", F.when(F.col("t") != 5, F.col("x")))
    with pytest.raises(ValueError):
        ds.simplex(holed, "x", "y", (1, 20), (21, 29), E=2, ignoreNan=False)


def test_layout(spark):
    values = [float((7 * v) % 11) for v in range(20)]
    df = line(spark, 20, y=values)
    ahead = ds.simplex(df, "y", "y", (1, 15), (16, 20), E=2, Tp=3).collect()
    assert [r["t"] for r in ahead] == list(range(16, 24))
    # the last of it is beyond the data: observations end with the predicted rows
    assert [r["Observations"] is not None for r in ahead] == [True] * 5 + [False] * 3
    assert [r["Predictions"] is not None for r in ahead] == [False] * 3 + [True] * 5
    back = ds.simplex(df, "y", "y", (1, 15), (10, 14), E=2, Tp=-2).collect()
    assert [r["t"] for r in back] == list(range(8, 15)) and [r["Predictions"] is not None for r in back] == [True] * 5 + [False] * 2
    days = df.withColumn("t", F.expr("date_add(date '2020-01-01', t)"))
    later = ds.simplex(days, "y", "y", (1, 15), (16, 20), E=2, Tp=1).collect()
    assert later[0]["t"] == datetime.date(2020, 1, 17) and later[-1]["t"] is None
    two = ds.simplex(df, "y", "y", (1, 12), "13 15 18 20", E=2).collect()
    assert [r["t"] for r in two] == [13, 14, 15, 16, 18, 19, 20, 21]


def test_results(spark, tmp_path):
    df = line(spark, 30, y=[math.sin(v / 3) for v in range(30)])
    out = ds.simplex(df, "y", "y", (1, 20), (21, 29), E=2, parameterList=True, includeState=True, pathOut=str(tmp_path), predictFile="out.csv")
    assert out.parameters["E"] == 2 and set(out.state) == {"neighbors", "lib_i", "pred_i", "target", "embedding"}
    assert out.state["embedding"].columns == ["row_id", "y(t-0)", "y(t-1)"] and out.state["neighbors"].count() == 27
    read = spark.read.csv(str(tmp_path / "out.csv"), header=True, inferSchema=True)
    assert read.columns == ["t", "Observations", "Predictions", "Pred_Variance"] and read.count() == out.predictions.count()
    s = ds.smap(df, "y", "y", (1, 20), (21, 29), E=2, theta=1, includeState=True)
    assert s.singularValues.columns == ["Time", "C0", "C1", "C2"] and "∂y/∂y(t-1)" in s.coefficients.columns
    p = ds.plot_obs_pred(out.predictions, "line", 2, 1)
    assert "rho=" in p.title and p.frame.columns == ["x", "Observations", "Predictions"]
    assert len(ds.plot_smap(s)) == 2 and ds.plot_ccm(spark.createDataFrame([(1, 0.5, 0.6)], "LibSize int, `a:b` double, `b:a` double")).lines == ["a:b", "b:a"]


def test_missing_values_in_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("t,x,y\n1,1,2\n2,NA,3\n3,nan,\n4,4.5,NaN\n5,NAN,6\n")
    df, _ = sr.resolve_input(spark, None, "in.csv", str(tmp_path))
    rows = [tuple(None if v is None or v != v else v for v in r) for r in df.orderBy("t").collect()]
    assert rows == [(1, 1.0, 2.0), (2, None, 3.0), (3, None, None), (4, 4.5, None), (5, None, 6.0)]


def test_sweep_arguments(spark, tmp_path):
    df = line(spark, 40, y=[math.sin(v / 3) for v in range(40)])
    out = ds.embed_dimension(df, "y", "y", (1, 20), (21, 39), maxE=2, parameterList=True, predictFile="rho.csv", pathOut=str(tmp_path), showPlot=False, numProcess=4, verbose=False)
    assert out.parameters["maxE"] == 2 and out.predictions.columns == ["E", "rho"]
    assert (tmp_path / "rho.csv").is_file() and (tmp_path / "rho.csv").read_text().splitlines()[0] == "E,rho"


def test_compute_error(spark):
    same = spark.createDataFrame([(float(i), float(i)) for i in range(10)], "Observations double, Predictions double")
    r = ds.compute_error(same).head()
    assert r["rho"] == 1 and r["RMSE"] == 0
    assert all(v is None for v in ds.compute_error(same.limit(3)).head())
    flat = same.withColumn("Predictions", F.lit(2.0))
    r = ds.compute_error(flat).head()
    assert r["rho"] is None and r["MAE"] == 7 and r["CAE"] == 31 and r["MAE_true"] == 3.1
    odd = same.union(spark.createDataFrame([(float("nan"), 1.0), (1.0, None), (float("inf"), 1.0)], "Observations double, Predictions double"))
    assert ds.compute_error(odd).head()["rho"] == 1


def dense_spline(x, y, w, scatter):
    """By eigenvectors of the roughness among all places."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    root = np.sqrt(w)
    values, vectors = np.linalg.eigh(q @ np.linalg.solve(r, q.T) / root[:, None] / root[None, :])
    values, coded, best = np.maximum(values, 0), vectors.T @ (root * y), None
    for penalty in np.logspace(-8, 8, 161) / (values.sum() / (n - 2)):
        shrink = 1 / (1 + penalty * values)
        rest, free = ((1 - shrink) * coded) ** 2, w.sum() - shrink.sum()
        score = w.sum() * (rest.sum() + scatter) / free**2
        if best is None or score < best[0]:
            best = (score, shrink)
    return (vectors @ (best[1] * coded)) / root


def test_surrogates(spark):
    rng = np.random.default_rng(0)
    for n in (64, 65):
        x = rng.normal(size=n) + 3
        y = phase_randomised(x, rng)
        assert abs(y.mean()) < 1e-9 and abs(y.std(ddof=1) - x.std(ddof=1)) < 1e-9
        a, b = np.abs(np.fft.rfft(x))[1 : n // 2], np.abs(np.fft.rfft(y))[1 : n // 2]
        assert np.corrcoef(a, b)[0, 1] > 0.999
    season = np.tile(np.sin(np.arange(12) / 12 * 2 * np.pi), 20)
    noisy = season + rng.normal(0, 0.2, len(season))
    by_phase = noisy.reshape(-1, 12)
    scatter = ((by_phase - by_phase.mean(axis=0)) ** 2).sum()
    assert np.corrcoef(cycle_of(np.arange(12), by_phase.mean(axis=0), np.full(12, 20.0), scatter, 12), season[:12])[0, 1] > 0.99
    for n in (4, 5, 24, 90):
        at, w = np.sort(rng.choice(400, n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float)
        y = np.sin(at / 40) + 0.3 * rng.normal(size=n)
        assert np.allclose(smoothing_spline(at, y, w, 2.0), dense_spline(at, y, w, 2.0), atol=1e-9)
    began = time.process_time()
    smoothing_spline(np.arange(6_000.0), rng.normal(size=6_000), np.ones(6_000), 1.0)
    assert time.process_time() - began < 10
    assert np.allclose(smoothing_spline(np.arange(6.0), np.arange(6.0), np.ones(6)), np.arange(6.0))
    s = ds.load(line(spark, 24, y=[float(v % 12) for v in range(24)]))
    shuffled = ds.surrogate_data(s, "y", "random_shuffle", 3, seed=5)
    for k in (1, 2, 3):
        assert sorted(r["value"] for r in shuffled.where(F.col("surr_id") == k).collect()) == sorted(float(v % 12) for v in range(24))
    assert wide(shuffled, 3).columns == ["row_id", "surr_1", "surr_2", "surr_3"]
    again = ds.surrogate_data(s, "y", "seasonal", 2, T_period=12, alpha=0.1, seed=5)
    assert again.count() == 48 and again.orderBy("surr_id", "row_id").collect() == ds.surrogate_data(s, "y", "seasonal", 2, T_period=12, alpha=0.1, seed=5).orderBy("surr_id", "row_id").collect()
    plain = ds.surrogate_data(s, "y", "seasonal", 1, T_period=12, seed=5).toPandas()
    assert abs(plain["value"].sum() - sum(v % 12 for v in range(24))) < 1e-9 and plain["row_id"].nunique() == 24
    holed = ds.load(line(spark, 5, y=[1.0, None, 2.0, 3.0, 4.0]))
    for method in ("ebisuzaki", "seasonal"):
        with pytest.raises(ValueError):
            ds.surrogate_data(holed, "y", method, 2)
    with pytest.raises(ValueError):
        ds.surrogate_data(s, "y", "other")


def test_ccm_does_not_depend_on_dispatch(spark):
    df = line(spark, 60, y=[math.sin(v / 4) + 0.1 * (v % 5) for v in range(60)], z=[math.cos(v / 5) for v in range(60)])
    a = ds.ccm(df, "y", "z", E=2, libSizes=(10, 30), sample=5, seed=42).collect()
    b = ds.ccm(df.repartition(7), "y", "z", E=2, libSizes=(10, 30), sample=5, seed=42).collect()
    assert a == b
    assert a != ds.ccm(df, "y", "z", E=2, libSizes=(10, 30), sample=5, seed=43).collect()


def test_multiview_options(spark):
    df = line(spark, 60, y=[math.sin(v / 4) for v in range(60)], z=[math.cos(v / 5) for v in range(60)])
    out = ds.multiview(df, "y z", "y", E=2, excludeTarget=True, D=1)
    assert {r["Columns"] for r in out.View.collect()} <= {"('z(t-0)')", "('z(t-1)')"}
    assert ds.multiview(df, "y z", "y", (1, 30), (31, 59), E=1, D=2, multiview=1, knn=4).View.count() == 1
    assert ds.multiview(df, "y z", "y", (1, 30), (31, 57), E=2, tau=1, D=2).Predictions.count() == 28
