"""Every registered query against its SQL on the whole small tables."""

import pytest
from compare import connect, difference, duck_result, spark_result

from pulsegrid.catalog import load_all

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(spark_result(QUERIES[name](spark, SF)), duck_result(con, SQL[name])) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
