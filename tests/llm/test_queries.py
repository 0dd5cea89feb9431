"""Queries with SQL equal DuckDB; no query runs Python where only expressions are allowed."""

import pytest

from compare import compare, duck
from tablewright.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SMALL), QUERIES[name], ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", ["op7_quality_rules", "op10_licenses"])
def test_native(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
