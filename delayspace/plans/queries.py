"""The registered queries of the modelling operators, on series made of the driver's tables.

Each runs over its whole table. Results are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import compute_error
from ..operators.ccm import ccm
from ..operators.embed import embed, embed_series
from ..operators.layout import layout
from ..operators.multiview import multiview
from ..operators.neighbors import neighbors
from ..operators.simplex import panel_simplex, project, simplex, simplex_neighbors
from ..operators.smap import local_maps, smap
from ..operators.state import State, prepare
from ..operators.surrogate import surrogate_data
from ..operators.sweeps import embed_dimension, predict_exclusion_radius, predict_interval, predict_nonlinear
from ..plans.index import create_indices, within
from ..sources.series import ROW, Series, load, quoted
from ..sources.tables import hourly, monthly_orders, prices, vectors

#: All components of the table's vectors.
EMBEDDED_DIMS = 64
RADII = (0, 2, 5, 10)
THETAS = (0.0, 1.0, 3.0)
CCM_SIZES = (50, 200)
CCM_TRIALS = 3
SEED = 7


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(quoted(c), digits).alias(c) if t == "double" else quoted(c) for c, t in df.dtypes])


def series(spark: SparkSession, sf_dir: str) -> Series:
    return load(hourly(spark, sf_dir))


def halves(s: Series) -> dict:
    """The first half as library, the second but its last row as predictions."""
    return {"lib": (1, s.n // 2), "pred": (s.n // 2 + 1, s.n - 1)}


def state(s: Series, columns="x", target="x", lib=None, pred=None, E=3, Tp=1, tau=-1, embedded=False, validLib=None) -> State:
    h = halves(s)
    return prepare("query", None, s, columns, target, lib or h["lib"], pred or h["pred"], E, Tp, tau, embedded, validLib, False, True, "", "")


def _embedding(columns: list[str], E: int, tau: int):
    return lambda spark, d: rounded(embed_series(series(spark, d), columns, E, tau).drop("t"))


def embed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embed(monthly_orders(spark, sf_dir), E=2, tau=-1, columns="y", includeTime=True))


def embed_plusminus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(embed(hourly(spark, sf_dir), E=2, tau=-1, plusminus=True))


def lib_pred_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    ix = create_indices(f"1 100 150 {s.n // 2}", f"{s.n // 2 + 1} {s.n}", 3, -2, 2, False, s.n)
    chosen = lambda part, ranges: s.df.where(within(ranges, F.col(ROW))).select(F.lit(part).alias("part"), ROW)
    return chosen("lib", ix.lib).union(chosen("pred", ix.pred))


def _near(k: int = 4, radius: int = 0, **how):
    def run(spark, d):
        s = series(spark, d)
        if how.get("lib") == "all":
            st = state(s, **{**how, "lib": (1, s.n), "pred": (1, s.n)})
        elif how.get("lib") == "two":
            st = state(s, **{**how, "lib": f"1 100 200 {s.n // 2}"})
        else:
            st = state(s, **how)
        return rounded(neighbors(st.pred(), st.lib(), st.dims, k, radius, st.indices.n_pred, st.indices.n_lib).select("p", "l", "rank", "d"))

    return run


def nn_embedded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(vectors(spark, sf_dir, EMBEDDED_DIMS))
    st = state(s, [f"e{j}" for j in range(EMBEDDED_DIMS)], "label", embedded=True, Tp=0)
    return rounded(neighbors(st.pred(), st.lib(), st.dims, 5, 0, st.indices.n_pred, st.indices.n_lib).select("p", "l", "rank", "d"))


def nn_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = state(load(prices(spark, sf_dir)))
    return rounded(neighbors(st.pred(), st.lib(), st.dims, 4, 0, st.indices.n_pred, st.indices.n_lib).select("p", "l", "rank", "d"))


def simplex_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = state(load(prices(spark, sf_dir)), "x", "y", E=2)
    out = layout(st.series, st.target, project(simplex_neighbors(st, 0, 10)), st.indices, st.Tp, keep_row=True)
    return rounded(out.select(ROW, "Observations", "Predictions", "Pred_Variance"))


def _laid(radius: int = 0, **how):
    def run(spark, d):
        s = series(spark, d)
        st = state(s, **{**how, **({"lib": (1, s.n), "pred": (1, s.n)} if how.get("lib") == "all" else {})})
        out = layout(st.series, st.target, project(simplex_neighbors(st, 0, radius)), st.indices, st.Tp, keep_row=True)
        return rounded(out.select(ROW, "Observations", "Predictions", "Pred_Variance"))

    return run


def simplex_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    holed = s.df.withColumn("x", F.when(F.col(ROW) % 17 != 0, F.col("x"))).withColumn("y", F.when(F.col(ROW) % 23 != 0, F.col("y")))
    st = state(Series(holed, s.time, s.n), "x", "y", E=2)
    out = layout(st.series, st.target, project(simplex_neighbors(st, 0, 0)), st.indices, st.Tp, keep_row=True)
    return rounded(out.select(ROW, "Observations", "Predictions", "Pred_Variance"))


def simplex_notime(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(hourly(spark, sf_dir)).df.orderBy(ROW).select("x", "y")
    n = df.count()
    return rounded(simplex(df, "x", "y", (1, n // 2), (n // 2 + 1, n - 1), E=2, noTime=True))


def error_of_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_error(_laid()(spark, sf_dir))


def _sweep(run, **how):
    def query(spark, d):
        s = series(spark, d)
        return run(s, "x", "y", **halves(s), **how)

    return query


def _smap(E: int, theta: float, target: str = "y"):
    def run(spark, d):
        st = state(series(spark, d), "y", target, E=E)
        maps = local_maps(st, [theta], 0, 0)
        return rounded(maps.select(F.col("p"), F.col("pred").alias("Predictions"), F.col("var").alias("Pred_Variance"), *[F.col("c")[j].alias(f"C{j}") for j in range(E + 1)]))

    return run


def smap_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return rounded(smap(s, "y", "y", **halves(s), E=3, theta=2).singularValues)


def _ccm(**how):
    def run(spark, d):
        s = series(spark, d)
        sizes = how.get("libSizes") or [s.n]
        return rounded(ccm(s, "x", "y", **{**how, "libSizes": sizes}))

    return run


def _views(which: str):
    def run(spark, d):
        s = series(spark, d)
        out = multiview(s, "x y", "x", **halves(s), E=2, trainLib=which == "train")
        if which in ("rank", "train"):
            return rounded(out.View)
        return rounded(out.Predictions)

    return run


def _surrogate(method: str, **how):
    def run(spark, d):
        return rounded(surrogate_data(series(spark, d), "y", method, num_surr=5, seed=SEED, **how))

    return run


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panel_simplex(hourly(spark, sf_dir, ["event_type"]), ["event_type"], "t", "x", "y", None, None, E=2))


@cache
def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "embed_uni": _embedding(["x"], 3, -1),
        "embed_multi": _embedding(["x", "y"], 2, -1),
        "embed_lead": _embedding(["x"], 3, 1),
        "embed_tau2": _embedding(["y"], 3, -2),
        "embed_time": embed_time,
        "embed_plusminus": embed_plusminus,
        "lib_pred_index": lib_pred_index,
        "nn_disjoint": _near(),
        "nn_loo": _near(lib="all"),
        "nn_exclusion": _near(lib="all", radius=5),
        "nn_validlib": _near(columns="x", target="y", validLib="y > 50"),
        "nn_disjoint_lib": _near(lib="two"),
        "nn_embedded_vectors": nn_embedded_vectors,
        "nn_large": nn_large,
        "simplex_large": simplex_large,
        "simplex_uni": _laid(),
        "simplex_multi": _laid(columns="x y", target="y", E=2),
        "simplex_embedded": _laid(columns="x y", target="y", embedded=True),
        "simplex_neg_tp": _laid(columns="x", target="y", Tp=-2),
        "simplex_tp0": _laid(columns="x", target="y", Tp=0),
        "simplex_cross_target": _laid(columns="y", target="x", E=2),
        "simplex_exclusion": _laid(columns="y", target="y", E=2, lib="all", radius=7),
        "simplex_validlib": _laid(columns="y", target="y", E=2, validLib="x % 2 = 0"),
        "simplex_nan": simplex_nan,
        "simplex_variance": _laid(columns="y", target="y", E=4),
        "simplex_notime": simplex_notime,
        "compute_error": error_of_simplex,
        "embed_dimension": _sweep(embed_dimension, maxE=5),
        "predict_interval": _sweep(predict_interval, maxTp=5, E=2),
        "predict_exclusion_radius": _sweep(predict_exclusion_radius, exclusionRadius=RADII, E=2),
        "predict_nonlinear_e1": _sweep(predict_nonlinear, theta=THETAS, E=1),
        "embed_dimension_default": _sweep(embed_dimension),
        "predict_interval_default": _sweep(predict_interval),
        "predict_exclusion_radius_default": _sweep(predict_exclusion_radius),
        "predict_nonlinear_default": _sweep(predict_nonlinear),
        "smap_e3": _smap(3, 2.0),
        "smap_e1": _smap(1, 2.0),
        "smap_e2": _smap(2, 2.0),
        "smap_theta0": _smap(2, 0.0, "x"),
        "smap_singular_values": smap_singular_values,
        "ccm_full_library": _ccm(E=2),
        "ccm_full_exclusion": _ccm(E=2, Tp=1, exclusionRadius=3),
        "ccm_sampled_md5": _ccm(E=2, libSizes=CCM_SIZES, sample=CCM_TRIALS, seed=SEED, includeData=True),
        "multiview_rank": _views("rank"),
        "multiview_predict": _views("predict"),
        "multiview_train": _views("train"),
        "surrogate_shuffle": _surrogate("random_shuffle"),
        "surrogate_ebisuzaki": _surrogate("ebisuzaki"),
        "surrogate_seasonal": _surrogate("seasonal", T_period=24, alpha=0.1),
        "panel_simplex": panel,
    }
