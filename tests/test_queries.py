"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NULL"
    return str(value)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(spark, duck, name):
    result = entry_module.queries()[name](spark, SF_DIR)
    expected = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(result.columns) == sorted(expected.columns)
    types = {f.name: TYPES[f.dataType.simpleString()] for f in result.schema.fields}
    assert types == dict(zip(expected.columns, map(str, expected.types)))
    assert bag(result.collect(), result.columns) == bag(expected.fetchall(), expected.columns)


def test_every_oracle_belongs_to_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
