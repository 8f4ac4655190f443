"""Every registered query beside its SQL twin on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakeproof.plans import catalog
from tools.check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = {r["status"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"matched", "changed", "missing", "extra"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = canonical(QUERIES[name](spark, FOLDER).toPandas())
    want = canonical(db.sql(ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
