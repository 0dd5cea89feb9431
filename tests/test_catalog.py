"""Every catalog query with SQL equals DuckDB on the smallest tables."""

import pytest

from compare import compare, duck
from conftest import SMALL
from tablewright.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SMALL) == ""


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert entry(spark).count() == 3
    assert set(oracle_sql()) <= set(queries())
