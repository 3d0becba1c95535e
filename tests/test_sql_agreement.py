"""Every query that has SQL gives the same rows as that SQL, on the smallest given tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    note = compare(got, want)
    assert "differ" not in note and "rows" not in note and "columns" not in note, note


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
