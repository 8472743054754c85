"""Local maps by tiles and triangular factors against dense least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from delayspace.functions.kernels import k_first, solved_maps, triangles
from delayspace.operators import smap as sm
from delayspace.operators.state import prepare


def series(spark, n=260, holes=True):
    rng = np.random.default_rng(3)
    x = np.round(np.cumsum(rng.normal(size=n)) % 7, 1)
    y = np.sin(x) + 0.3 * rng.normal(size=n)
    rows = [(i, float(x[i]), None if holes and i % 19 == 3 else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "t long, x double, y double")


def dense(state, k, radius, thetas):
    """{(p, theta): (prediction, variance, coefficients, singular values)} by one least squares problem for each row."""
    d = state.dims
    pred = [(r["p"], np.array([r[f"a{j}"] for j in range(d)])) for r in state.pred().collect()]
    lib = [(r["l"], np.array([r[f"b{j}"] for j in range(d)]), r["y"]) for r in state.lib().collect()]
    out = {}
    for p, a in pred:
        near = sorted((float(np.sqrt(((a - b) ** 2).sum())), abs(p - row), row, b, y) for row, b, y in lib if abs(p - row) > radius)[:k]
        mean = np.mean([x[0] for x in near]) if near else 0
        used = [x for x in near if x[4] is not None]
        for theta in thetas:
            if not used:
                out[(p, theta)] = None
                continue
            w = np.exp(-theta * np.array([x[0] for x in used]) / mean) if mean > 0 else np.ones(len(used))
            m = np.column_stack((np.ones(len(used)), np.stack([x[3] for x in used])))
            y = np.array([x[4] for x in used])
            c, _, _, s = np.linalg.lstsq(m * w[:, None], y * w, rcond=np.finfo(float).eps * max(m.shape))
            got = c[0] + c[1:] @ a
            out[(p, theta)] = (got, (w * (y - got) ** 2).sum() / w.sum(), c, s)
    return out


@pytest.mark.parametrize(("tile", "knn", "radius"), [(20_000, 0, 0), (40, 0, 0), (40, 0, 12), (40, 20, 3), (40, 100, 3), (7, 0, 0)])
def test_maps_against_dense_least_squares(spark, monkeypatch, tile, knn, radius):
    monkeypatch.setattr(sm, "FAN_IN", 4)
    state = prepare("smap", None, series(spark), "x", "y", (1, 130), (101, 259), 3, 1, -1, False, None, False, True, "", "")
    thetas = [0.0, 2.5]
    k = sm.default_knn(state, knn)
    want = dense(state, k, radius, thetas)
    got = {(r["p"], r["theta"]): r for r in sm.local_maps(state, thetas, knn, radius, tile).collect()}
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        assert np.allclose([r["pred"], r["var"]], w[:2], rtol=1e-9, atol=1e-9)
        assert np.allclose(r["c"], w[2], rtol=1e-8, atol=1e-8)
        assert np.allclose([x for x in r["s"] if x is not None], w[3], rtol=1e-9, atol=1e-9)


def test_maps_of_few_rows(spark):
    """Fewer library rows than coefficients, and none within reach."""
    state = prepare("smap", None, series(spark, 12, holes=False), "x", "y", (1, 6), (5, 11), 3, 1, -1, False, None, False, True, "", "")
    for radius in (0, 4, 20):
        want = dense(state, sm.default_knn(state, 0), radius, [1.0])
        for tile in (20_000, 2):
            got = {(r["p"], r["theta"]): r for r in sm.local_maps(state, [1.0], 0, radius, tile).collect()}
            assert set(got) == set(want)
            for key, w in want.items():
                r = got[key]
                if w is None:
                    assert r["pred"] is None and r["c"] == [None] * 4 and r["s"] == [None] * 4
                else:
                    assert np.allclose([r["pred"], r["var"]], w[:2], atol=1e-8)
                    assert len([x for x in r["s"] if x is not None]) == len(w[3])


def test_factors_stack():
    rng = np.random.default_rng(0)
    m, b = rng.normal(size=(90, 4)), rng.normal(size=90)
    parts = [triangles(np.column_stack((m, b))[None, at : at + 30])[0] for at in (0, 30, 60)]
    whole = triangles(np.concatenate(parts)[None])
    spread = triangles(np.column_stack((np.ones(90), b))[None])
    got, var, c, s = solved_maps(np.zeros((1, 3)), whole, spread, np.array([90]))
    want, _, _, sv = np.linalg.lstsq(m, b, rcond=None)
    assert np.allclose(c[0], want) and np.allclose(s[0], sv) and np.isclose(var[0], ((b - got[0]) ** 2).mean())


def test_first_of_ties():
    d = np.array([[1.0, 1.0, 1.0, 0.5, np.inf], [np.inf] * 5])
    gap, rows = np.array([[3, 1, 1, 9, 9]] * 2), np.array([10, 12, 11, 5, 6])
    assert k_first(d, gap, rows, 3).tolist() == [[False, True, True, True, False], [False] * 5]
    assert k_first(d, gap, rows, 0).sum() == 0 and k_first(d, gap, rows, 5).sum() == 4


def test_default_neighbours_of_sweep(spark):
    """The sweep over weights goes by tiles too."""
    from delayspace.operators.sweeps import predict_nonlinear

    got = predict_nonlinear(series(spark), "x", "y", (1, 130), (131, 258), theta=[0, 2], E=2)
    assert got.where(F.col("rho").isNotNull()).count() == 2
