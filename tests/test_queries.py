"""Every registered query against its SQL, and the driver's three functions."""

import pytest

import __spark_entry__
from verification.compare import difference, duckdb_over
from verification.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return duckdb_over(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, con, small, name):
    assert difference(spark, con, name, small) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "email", "phone", "city"] and df.count() == 150


@pytest.mark.parametrize("name", ["tokenize_customers", "detect_all", "tag_state", "catalog_from_json"])
def test_no_python_in_the_plan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
