"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from faultgrain.bindings import BASE_TABLES
from faultgrain.queries import QUERIES
from tools.check import canonical

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with duckdb.connect() as opened:
        for name in BASE_TABLES:
            opened.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
        yield opened


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    relation = connection.sql(entry_points.oracle_sql()[name])
    assert sorted(result.columns) == sorted(relation.columns)
    got = canonical(result.columns, [tuple(row) for row in result.collect()])
    assert got == canonical(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
