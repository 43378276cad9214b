"""Every named query against SQL on the same tables."""

import pytest

import __spark_entry__ as driver
import oracle
from fedlens.catalog import index

QUERIES, SQL = index.all_queries(), index.all_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) > 0
    if name in SQL:
        assert oracle.differences(got, con.sql(SQL[name]).df()) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0
    assert driver.queries().keys() >= driver.oracle_sql().keys()
