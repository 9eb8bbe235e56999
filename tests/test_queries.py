"""Every registered query with a SQL counterpart gives DuckDB's rows."""

import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    assert not difference(spark, con, SF, catalog.QUERIES[name], catalog.ORACLE[name])


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and {"l_returnflag", "sum_qty"} <= set(rows[0].asDict())
    assert set(entry.oracle_sql()) <= set(entry.queries())
