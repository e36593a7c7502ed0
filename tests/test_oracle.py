"""Every registered query with SQL: same values from Spark and DuckDB."""

import os

import pytest

import __spark_entry__ as entry_points
from tests import compare

SF = os.environ.get("FLOWWARDEN_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    spark_side = compare.spark_rows(QUERIES[name](spark, SF))
    assert compare.difference(spark_side, compare.duck_rows(con, SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert [r["severity_level"] for r in sorted(rows)] == [0, 1, 2, 3]
