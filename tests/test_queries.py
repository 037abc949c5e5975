"""Every query against its SQL in DuckDB; the others give rows."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from quillon.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float) if df[c].dtype.kind in "fiub" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    ours, theirs = tidy(QUERIES[name](spark, SF).toPandas()), tidy(con.sql(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) > 0
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            assert np.allclose(ours[c], theirs[c], rtol=1e-9, atol=1e-12, equal_nan=True), c
        else:
            assert (ours[c] == theirs[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
