"""Every query of the catalogue against its SQL on the smallest scale."""

import pytest

from sitlake.plans import catalogue

from .conftest import DATA
from .oracle import compare, connect

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_agree(spark, con, name):
    assert compare(spark, con, catalogue.queries()[name], SQL[name], DATA) is None
