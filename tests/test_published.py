"""Forecasts of a circle against published results. The series is made here, so these run anywhere."""

import math

import pytest
from pyspark.sql import functions as F

import delayspace as ds


def circle_rows():
    """Two turns in 200 steps, to four places as published."""
    return [(i + 1, round(math.sin(4 * math.pi * i / 199), 4), round(math.cos(4 * math.pi * i / 199), 4)) for i in range(200)]


@pytest.fixture(scope="module")
def circle(spark):
    return spark.createDataFrame(circle_rows(), "Time int, x double, y double")


@pytest.fixture(scope="module")
def holed(spark):
    rows = [(t, None if t in (6, 7, 13) else x, None if t in (11, 12, 18) else y) for t, x, y in circle_rows()]
    return spark.createDataFrame(rows, "Time int, x double, y double")


# Calls and what they give, from the place of the first on.
SIMPLEX = {
    "valid": (dict(columns="x", target="x", lib=(1, 200), pred=(1, 200), E=2), 1, [0.589116, 0.588951, 0.588725, 0.588396, 0.587877, 0.586942]),
    "disjoint": (dict(columns="x", target="x", lib="1 40 50 130", pred="80 170", E=2, tau=-3), 30, [0.572523, 0.623145, 0.671271]),
    "radius": (dict(columns="x", target="y", lib=(1, 100), pred=(21, 81), E=2, exclusionRadius=5), 1, [-0.387607, -0.327352, -0.305358, -0.346352, -0.415057, -0.221136]),
    "holed": (dict(columns="x", target="y", lib=(1, 100), pred=(1, 95), E=2), 1, [-0.27715, 0.334718, 0.32555, -0.281352, None, None]),
}
SMAP_E4 = [0.615563, 0.66403, 0.709878, 0.752889, 0.792948, 0.829864]
SMAP_EMBEDDED = [0.063108, 0.12595, 0.188353, 0.249901, 0.310508, 0.369865]
SMAP_MEANS = [0.99801, 0.06311]
CCM_LAST = {"radius": (0.936753, 0.994713), "tau": (0.999952, 0.999955), "holed": (0.987144, 0.993086)}


def near(rows, want, first):
    got = [r["Predictions"] for r in rows[first : first + len(want)]]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 2e-6) for a, b in zip(got, want, strict=True)), got


@pytest.mark.parametrize("name", SIMPLEX)
def test_simplex(circle, holed, name):
    args, first, want = SIMPLEX[name]
    more = {"validLib": (F.col("x") > 0.5) | (F.col("x") < -0.5)} if name == "valid" else {}
    near(ds.simplex(holed if name == "holed" else circle, **args, **more).collect(), want, first)


def test_smap(circle):
    near(ds.smap(circle, "x", "x", (1, 100), (110, 160), E=4, theta=3).predictions.collect(), SMAP_E4, 1)
    both = ds.smap(circle, "x y", "x", (1, 200), (1, 200), E=2, theta=3, embedded=True)
    near(both.predictions.collect(), SMAP_EMBEDDED, 1)
    assert [round(v, 5) for v in both.coefficients.agg(F.avg("`∂x/∂x`"), F.avg("`∂x/∂y`")).head()] == SMAP_MEANS


def test_ccm_of_whole_libraries(circle, holed):
    calls = {"radius": (circle, dict(Tp=3, exclusionRadius=5)), "tau": (circle, dict(tau=3)), "holed": (holed, dict(Tp=5))}
    for name, (df, args) in calls.items():
        row = ds.ccm(df, "x", "y", E=2, libSizes=[190 if name == "holed" else 200], sample=1, **args).head()
        assert abs(row["x:y"] - CCM_LAST[name][0]) < 2e-6 and abs(row["y:x"] - CCM_LAST[name][1]) < 2e-6, (name, row)
