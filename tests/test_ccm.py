"""Cross mapping against a search for every trial by itself."""

import hashlib

import numpy as np
import pytest

from delayspace.operators import ccm as cm
from delayspace.operators.ccm import ccm, estimates


def series(n=180, ties=False):
    rng = np.random.default_rng(5)
    x, y = [0.4], [0.2]
    for _ in range(n - 1):
        x.append(3.7 * x[-1] * (1 - x[-1]))
        y.append(y[-1] * (3.5 - 3.5 * y[-1] - 0.1 * x[-2]))
    x, y = np.array(x), np.array(y) + 0.01 * rng.normal(size=n)
    return (np.round(x, 1), np.round(y, 1)) if ties else (x, y)


def brute(a, b, name, E, k, radius, sizes, trials, seed):
    """Mean and variance of the skill by size, of states of a against b."""
    rows = list(range(E, len(a) + 1))  # numbered from 1
    state = {r: np.array([a[r - 1 - j] for j in range(E)]) for r in rows}
    out = {}
    for size in sizes:
        rhos = []
        for t in range(trials if size < len(rows) else 1):
            L = min(size, len(rows))
            lib = rows if L == len(rows) else sorted(rows, key=lambda r: hashlib.md5(f"{seed}|{name}|{size}|{t}|{r}".encode()).hexdigest())[:L]
            want = min(k, L - 1)
            o, q = [], []
            for p in rows:
                near = sorted((float(np.sqrt(((state[p] - state[r]) ** 2).sum())), abs(p - r), r) for r in lib if abs(p - r) > radius)[:want]
                if want < 1 or len(near) < want:
                    continue
                d = np.array([x[0] for x in near])
                w = np.exp(-d / d[0]) if d[0] > 0 else (d == 0).astype(float)
                o.append(b[p - 1])
                q.append((w * np.array([b[x[2] - 1] for x in near])).sum() / w.sum())
            if len(o) >= 3:
                rhos.append(np.corrcoef(o, q)[0, 1] if np.std(o) * np.std(q) > 0 else 0.0)
        out[size] = (np.mean(rhos), np.var(rhos)) if rhos else (None, None)
    return out


@pytest.mark.parametrize(("prefix", "ties", "radius"), [(512, False, 0), (40, False, 2), (2, True, 0), (60, True, 8)])
def test_trials_against_brute_force(spark, monkeypatch, prefix, ties, radius):
    monkeypatch.setattr(cm, "PREFIX", prefix)
    monkeypatch.setattr(cm, "DIGITS", 1)
    x, y = series(ties=ties)
    sizes, trials, seed = [1, 4, 20, 90, 180], 3, 9
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t long, x double, y double")
    got = {r["LibSize"]: r for r in ccm(df, "x", "y", E=2, libSizes=sizes, sample=trials, seed=seed, exclusionRadius=radius, includeData=True).collect()}
    for name, a, b in (("x:y", x, y), ("y:x", y, x)):
        for size, (mean, var) in brute(a, b, name, 2, 3, radius, sizes, trials, seed).items():
            if mean is None:
                assert got[size][name] is None
            else:
                assert np.isclose(got[size][name], mean, atol=1e-9) and np.isclose(got[size][f"{name}_var"], var, atol=1e-9)


def test_estimates():
    d, y = np.array([0.0, 0.0, 1.0, 2.0]), np.array([1.0, 3.0, 5.0, 7.0])
    member = np.array([[1, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], bool)
    q, n = estimates(d, y, member, np.array([3, 2, 2]))
    w = np.exp([-1.0, -2.0])
    assert np.isclose(q[0], 2.0) and np.isclose(q[1], (w * [5, 7]).sum() / w.sum()) and n.tolist() == [3, 2, 0]


def test_drawn_rows_are_the_smallest_keys(spark):
    points = spark.range(1, 500).withColumnRenamed("id", "row_id")
    tasks = spark.createDataFrame([(0, 30, 0, 30, 3), (1, 30, 1, 30, 3), (2, 400, 0, 400, 3)], "task int, lib_size long, trial long, L long, k int")
    got = {}
    for r in cm.drawn_rows(points, tasks, 1, "a:b").collect():
        got.setdefault(r["task"], set()).add(r["row_id"])
    for task, size, trial in ((0, 30, 0), (1, 30, 1), (2, 400, 0)):
        assert got[task] == set(sorted(range(1, 500), key=lambda r: hashlib.md5(f"1|a:b|{size}|{trial}|{r}".encode()).hexdigest())[:size])
