"""Every registered query with SQL, against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from spanmill.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "nation", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
