"""Every query with SQL against DuckDB on the smallest tables, where those are at hand."""

import os

import pytest

from contactloom.plans.all import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    import pandas as pd

    cols = sorted(frame.columns)
    tidy = lambda v: None if pd.isna(v) is True else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(repr([tidy(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
