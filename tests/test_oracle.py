"""Every registered query runs, and equals its SQL in DuckDB where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hearthway.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]
TABLES += ["pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value) if value is None else str(value)


# The training-data queries have tests of their own.
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    found = entry.queries()[name](spark, SF_DIR)
    rows = found.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    columns = sorted(found.columns)
    assert columns == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "grid_id"
