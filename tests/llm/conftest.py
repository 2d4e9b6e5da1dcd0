import sys

import pytest
from pyspark import cloudpickle

import skytrace

cloudpickle.register_pickle_by_value(skytrace)
sys.setrecursionlimit(3000)

ODD = [
    (1, "one two three four", "a"), (1, "one two three four", "a"), (2, None, "b"), (3, "", None), (4, " \t\n ", "a"),
    (None, "no id here", "b"), (5, "ten words " * 5, None), (6, "x" * 20_000 + " y" * 20_000, "a"), (7, "é漢\U0001f600 ▁ ü", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names clash."""
    rows = [(*r, r[0], "k", 9.0, 1, True) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, row string, score double, size int, kept boolean")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (5, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
