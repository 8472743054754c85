"""Views by tiles against a search for each view by itself."""

from itertools import combinations

import numpy as np
import pytest

from delayspace.operators import multiview as mv
from delayspace.operators import neighbors as nb
from delayspace.operators.multiview import multiview


def frame(spark, n=150):
    rng = np.random.default_rng(2)
    x, y, z = np.cumsum(rng.normal(size=(3, n)), axis=1).round(1)
    rows = [(i, float(x[i]), None if i % 13 == 4 else float(y[i]), float(z[i])) for i in range(n)]
    return spark.createDataFrame(rows, "t long, x double, y double, z double"), rows


def brute(rows, D, E, lib, pred, k, radius, Tp):
    """{view: {p: forecast of x}}."""
    cols = [[r[c] for r in rows] for c in (1, 2, 3)]
    lags = [[c[i - j] if i >= j else None for i in range(len(rows))] for c in cols for j in range(E)]
    out = {}
    for view in combinations(range(len(lags)), D):
        out[view] = {}
        for p in range(*pred):
            a = [lags[j][p] for j in view]
            near = []
            for r in range(*lib):
                b = [lags[j][r] for j in view]
                if abs(p - r) > radius and None not in a and None not in b:
                    near.append((float(np.sqrt(sum((u - v) ** 2 for u, v in zip(a, b, strict=True)))), abs(p - r), r))
            near = sorted(near)[:k]
            if near:
                d = np.array([v[0] for v in near])
                w = np.exp(-d / max(d.min(), 1e-6))
                future = [cols[0][r + Tp] for _, _, r in near]
                out[view][p] = (w * future).sum() / w.sum()
    return out


@pytest.mark.parametrize(("tile", "work"), [(4_096, nb.WORK), (17, 2_000)])
def test_views_against_brute_force(spark, monkeypatch, tile, work):
    monkeypatch.setattr(nb, "WORK", work)
    monkeypatch.setattr(mv.view_projections, "__defaults__", (tile,))
    df, rows = frame(spark)
    got = multiview(df, "x y z", "x", (1, 80), (81, 149), D=2, E=2, multiview=5, exclusionRadius=2, trainLib=False)
    want = brute(rows, 2, 2, (0, 79), (80, 149), 3, 2, 1)
    rho = {}
    for view, made in want.items():
        o, q = zip(*[(rows[p + 1][1], v) for p, v in made.items()], strict=True)
        rho[view] = round(float(np.corrcoef(o, q)[0, 1]), 6)
    best = sorted(rho, key=lambda v: (-rho[v], v))[:5]
    names = [f"{c}(t-{j})" for c in "xyz" for j in range(2)]
    table = got.View.collect()
    assert [r["Columns"] for r in table] == ["(" + ", ".join(f"'{names[j]}'" for j in v) + ")" for v in best]
    assert np.allclose([r["rho"] for r in table], [rho[v] for v in best], atol=2e-6)
    said = {r["t"]: r["Predictions"] for r in got.Predictions.collect()}
    for p in range(80, 149):
        each = [want[v].get(p) for v in best]
        if None in each:
            assert said[p + 1] is None
        else:
            assert np.isclose(said[p + 1], np.mean(each))


def test_views_hand_on_neighbours_only(spark, monkeypatch):
    """What tiles hand on is views x rows x k for each chunk of the library, whatever the number of pairs."""
    seen = []
    ranked = nb.ranked_neighbors
    monkeypatch.setattr(nb, "ranked_neighbors", lambda found, *a: (seen.append(found), ranked(found, *a))[1])
    df, _ = frame(spark)
    multiview(df, "x y z", "x", (1, 80), (81, 149), D=2, E=1, trainLib=False)
    assert len(seen) == 2 and all(0 < f.count() <= 3 * 69 * 3 for f in seen)
