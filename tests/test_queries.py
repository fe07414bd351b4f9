"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from palaver import catalog
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    run, sql = catalog.queries()[name], catalog.oracle_sql().get(name)
    if sql is None:
        assert run(spark, SF).count() > 0
    else:
        assert difference(spark, con, SF, run, sql) == ""


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
