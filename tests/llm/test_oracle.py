"""Queries that SQL can express against their SQL on the smallest scale."""

import pytest

from sitlake.llm import queries as q

from ..conftest import DATA
from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_rows_agree(spark, name):
    assert compare(spark, connect(DATA), q.queries()[name], q.oracle_sql()[name], DATA) is None
