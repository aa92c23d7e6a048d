"""Every query with SQL gives the rows of its SQL; the others give rows."""

import pytest

import oracle
import workload

SF = "/root/testdata/sf0.001"
QUERIES, SQL = workload.all_queries(), workload.all_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
