"""Queries with SQL against it, on whole small tables."""

import pytest

from skytrace.llm.queries import QUERIES
from tests.compare import connect
from tests.llm.compare import differs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_oracle(spark, name):
    assert differs(spark, connect(SF), name, SF) is None
