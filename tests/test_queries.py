"""Every query with SQL gives on the smallest tables what DuckDB gives."""

import duckdb
import pytest

import __spark_entry__
from patrika.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_as_sql(spark, duck, name):
    got, want = queries()[name](spark, DATA), duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
