"""Registered queries against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The others take the same paths; the driver compares all.
CHECKED = ["embed_plusminus", "lib_pred_index", "nn_exclusion", "nn_disjoint_lib", "simplex_nan", "simplex_neg_tp", "compute_error", "predict_interval", "embed_dimension", "smap_e2", "smap_e3", "smap_singular_values", "predict_nonlinear_default", "embed_dimension_default", "nn_large", "simplex_large", "ccm_full_exclusion", "ccm_sampled_md5", "multiview_predict", "multiview_train", "nn_embedded_vectors", "surrogate_shuffle", "panel_simplex"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NaT or x != x else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, tables, name):
    assert shown(__spark_entry__.queries()[name](spark, SF).toPandas()) == shown(tables.execute(__spark_entry__.oracle_sql()[name]).fetchdf())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["row_id", "Observations", "Predictions", "Pred_Variance"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__spark_entry__.__file__).parent, capture_output=True, text=True, timeout=120, check=True)
    assert int(said.stdout.split()[0]) > 40
