"""Every registered query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.SQL]


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.QUERIES[name](spark, SF)
    rel = duck.sql(entry.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_traversal_has_mixed_confidence(spark):
    rows = entry.QUERIES["blast_radius"](spark, SF).collect()
    assert {r.confirmed for r in rows} == {True, False} and {r.depth for r in rows} == {1, 2, 3}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.QUERIES if n not in entry.SQL])
def test_queries_without_sql_run(spark, name):
    assert entry.QUERIES[name](spark, SF).count() > 0
