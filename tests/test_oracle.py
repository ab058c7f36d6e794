"""Every query of the graph engine against its SQL on the smallest tables."""

import pytest
from oracle_support import differences, duck

from bindloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_each_query_has_sql():
    assert set(SQL) == set(catalog.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    assert differences(catalog.queries()[name](spark, sf_dir), con, SQL[name]) == ""
