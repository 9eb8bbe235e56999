"""The SQL of the corpus operators gives the operators' rows."""

import pytest

from siltstone.llm import queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_rows(spark, con, name):
    assert not difference(spark, con, SF, queries.QUERIES[name], queries.ORACLE[name])
