"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry_points.queries()[name](spark, SF)
    want = duck.sql(entry_points.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    names = list(want.columns)
    left = sorted(repr([cell(r[c]) for c in columns]) for r in got.collect())
    right = sorted(repr([cell(r[names.index(c)]) for c in columns]) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
