"""Every registered query runs on the smallest tables; those with SQL must equal it."""

import pytest
from compare import compare, duck

from peakloom.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
