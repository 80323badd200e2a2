"""Every log query against its SQL on the smallest table."""

import os

import duckdb
import pandas as pd
import pytest

from loomtrace import queries

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(D):
        pytest.skip(f"no tables in {D}")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


def rows(df):
    cell = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, D).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)
