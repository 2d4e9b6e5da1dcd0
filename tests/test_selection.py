"""Radix selection against numpy, also with small fan-outs, equal and extreme values."""

import numpy as np
import pytest

from skytrace.operators import selection


@pytest.mark.parametrize(("fanout", "few"), [(4096, 4096), (64, 1)])
def test_percentiles_equal_numpy(spark, monkeypatch, fanout, few):
    monkeypatch.setattr(selection, "FANOUT", fanout)
    monkeypatch.setattr(selection, "FEW", few)
    rng = np.random.default_rng(4)
    groups = {
        1: rng.random(800), 2: np.repeat(0.25, 300), 3: np.array([7.0]), None: rng.choice([0.0, 1.0, 1.0, 5e-324], 90),
        5: np.concatenate((rng.lognormal(0, 40, 300), -rng.lognormal(0, 40, 300))), 6: np.array([-1.7e308, 1.7e308, 0.0, 1.0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in selection.percentiles(df, "v", wanted, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs) and (got[k]["min"], got[k]["max"]) == (vs.min(), vs.max())
        for name, q in wanted.items():
            np.testing.assert_allclose(got[k][name], np.quantile(vs, q), rtol=1e-9, err_msg=f"{k} {name}")


def test_without_groups_or_values(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "v double")
    one = selection.percentiles(df, "v", {"mid": 0.5}).collect()
    assert len(one) == 1 and (one[0]["n"], one[0]["mid"], one[0]["mean"]) == (2, 1.0, 1.0)
    none = selection.percentiles(df.limit(0), "v", {"mid": 0.5}).collect()
    assert len(none) == 1 and (none[0]["n"], none[0]["mid"]) == (0, None)
    assert selection.percentiles(df.limit(0).selectExpr("1 AS g", "v"), "v", {"mid": 0.5}, ["g"]).count() == 0


def test_no_range_exchange_and_no_sort_of_values(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS g", "double(id) AS v")
    plan = selection.percentiles(df, "v", {"mid": 0.5}, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
