import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from tallystream.plans import catalog

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    connection = connect(DIRECTORY)
    yield connection
    connection.close()


def test_entry(spark):
    assert {r.template for r in entry(spark).collect()} == {"low", "medium", "high"}


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, DIRECTORY, name) is None


@pytest.mark.parametrize("name", list(catalog.all_queries()))
def test_plans_have_no_cross_join_and_no_row_python(spark, name):
    """No Cartesian product or nested-loop join, and Python only in the operator that says so."""
    plan = queries()[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert ("MapInPandas" in plan) == name.startswith("heavy_hitters_bounded")
