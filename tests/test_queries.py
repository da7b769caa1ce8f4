"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def norm(v):
    if isinstance(v, float):
        return round(v, 4) + 0.0
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(small):
        con.sql(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    assert cols == sorted(rel.columns)
    mine = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    theirs = Counter(tuple(norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert mine == theirs


def test_entry(spark, small):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
