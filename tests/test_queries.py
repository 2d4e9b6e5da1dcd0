"""Every registered query against its oracle. TEST_SF picks the scale factor."""

import os

import pytest

from skytrace.plans import QUERIES
from tests.compare import check, connect

SF_DIR = "/root/testdata/" + os.environ.get("TEST_SF", "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, QUERIES[name], SF_DIR) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
