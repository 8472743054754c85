"""Registered queries of training data against their SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def shown(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NaT or x != x else str(int(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in row) for row in df.itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op4_suffix_dedup", "op6_url_filter", "op12_hard_negatives"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = shown(__spark_entry__.queries()[name](spark, SF).toPandas()), shown(con.execute(__spark_entry__.oracle_sql()[name]).fetchdf())
    assert got == want and got[0]
