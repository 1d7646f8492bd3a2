"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS FROM '{FOLDER}/{file}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 9))
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n.startswith("p")))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0
