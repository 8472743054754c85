"""Transforms in four steps against one of the whole series."""

import numpy as np
import pytest

import delayspace as ds
from delayspace.operators import fourier, surrogate


def series(spark, x):
    return spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x)], "i long, re double, im double").repartition(3)


@pytest.mark.parametrize(("n", "longest"), [(1, 100), (360, 100), (343, 100), (101, 50), (94, 20)])
def test_transform(spark, monkeypatch, n, longest):
    monkeypatch.setattr(fourier, "GROUP", 64)
    monkeypatch.setattr(fourier, "LONGEST", longest)
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    for inverse, whole in ((False, np.fft.fft), (True, np.fft.ifft)):
        got = {r["i"]: r["re"] + 1j * r["im"] for r in fourier.transform(series(spark, x), n, (), inverse).collect()}
        assert np.allclose([got[i] for i in range(n)], whole(x), atol=1e-10) and len(got) == n


@pytest.mark.parametrize("n", [240, 225])
def test_long_surrogates_keep_the_spectrum(spark, monkeypatch, n):
    monkeypatch.setattr(surrogate, "VALUES", 10)
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=n))
    s = ds.load(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, x double"))
    got = ds.surrogate_data(s, "x", "ebisuzaki", 3, seed=2).toPandas()
    seen = []
    for _, own in got.groupby("surr_id"):
        y = own.sort_values("row_id")["value"].to_numpy()
        assert len(y) == n and abs(y.mean()) < 1e-9 and np.isclose(y.std(ddof=1), x.std(ddof=1))
        a, b = (np.abs(np.fft.rfft(v))[1 : (n - 1) // 2] for v in (x, y))
        assert np.allclose(a / b, (a / b)[0], rtol=1e-9)
        seen.append(y)
    assert not np.allclose(seen[0], seen[1])
    again = ds.surrogate_data(s, "x", "ebisuzaki", 3, seed=2).toPandas()
    assert np.allclose(got.sort_values(["surr_id", "row_id"])["value"], again.sort_values(["surr_id", "row_id"])["value"])
