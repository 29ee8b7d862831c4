"""Every query with SQL gives the rows of its SQL."""

import pytest

from ragloom.plans import registry

from .oracle import compare, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, registry.queries()[name], SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
