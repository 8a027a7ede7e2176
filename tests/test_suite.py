"""Each query against its SQL in DuckDB on the smallest data."""

import os

import duckdb
import pytest

from citegrain import suite


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", list(suite.QUERIES))
def test_query(spark, sf, db, name):
    got = suite.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in suite.ORACLE_SQL:
        assert rows or name == "cycle_breaking"
        return
    want = db.sql(suite.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in rows) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
