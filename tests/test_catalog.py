"""Every named query runs; those with SQL equal it on the small tables."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry_point
from baitlens import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [*catalog.queries()])
def test_query(spark, con, name):
    status, _, _, rows = compare(spark, con, name, SF)
    assert status in ("ok", "rows-only"), status
    assert rows > 0


def test_contract(spark):
    names = set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= names
    assert set(catalog.queries()) <= names
    assert not [n for n in catalog.queries() if n == "pipeline" or n.startswith("op")]
    assert entry_point.entry(spark).count() == 3
