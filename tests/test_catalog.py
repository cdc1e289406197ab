"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="module")
def con():
    import duckdb
    import check_queries
    made = duckdb.connect()
    for name in check_queries.TABLES:
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    import check_queries
    state, _, _, note = check_queries.compare(spark, con, name, FOLDER)
    assert state in ("same", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
