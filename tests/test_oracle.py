"""Every registered query against its SQL, values and types."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF_DIR

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
SPARK_TO_DUCKDB = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _sortable(row):
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else v) for v in row)


def _canonical(rows):
    return sorted((_sortable(row) for row in rows), key=repr)


def test_every_query_has_sql():
    assert entry_points.ledger_queries().keys() <= entry_points.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(entry_points.ledger_queries()))
def test_matches_sql(spark, duck, name):
    result = entry_points.ledger_queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    expected = duck.sql(entry_points.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: SPARK_TO_DUCKDB[t] for c, t in result.dtypes} == types
    actual_rows = [tuple(row) for row in result.select(*columns).collect()]
    expected_rows = expected.select(*columns).fetchall()
    assert len(actual_rows) > 0
    assert _canonical(actual_rows) == _canonical(expected_rows)


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns[:2] == ["cui", "project"]
    assert result.count() > 0
