"""Splitting large keys must not change any result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from skytrace.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds most rows, with bursts in one clock cell, ties and an unknown key."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 40, n))
    t = np.sort(rng.integers(0, 200_000, n))
    t[500:900] = t[500]
    pdf = pd.DataFrame({"k": key, "t": t, "seq": np.arange(n), "x": rng.normal(size=n).round(3)})
    return spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 5, 99_999, 1.0)], "k long, t long, seq long, x double"))


def plain(rows):
    return rows, Window.partitionBy("k").orderBy("t", "seq")


@pytest.mark.parametrize("target", [60, 137, 100_000])
@pytest.mark.parametrize("broadcast", [True, False])
def test_spread_matches_plain_window(spark, rows, target, broadcast, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", 100_000 if broadcast else 3)
    monkeypatch.setattr(O.size_checked, "__defaults__", (O.BROADCAST_ROWS,))
    halo = 30
    pieces = O.spread(rows, ["k"], O.time_bucket("t", 1000), target, halo)
    w = O.piece_window(["k"], ["t", "seq"])
    got = O.own_rows(pieces.withColumns({
        "rn": O.row_number_in_key(["k"], ["t", "seq"]),
        "total": F.sum("x").over(w.rowsBetween(-halo, 0)),
        "back": F.lag("seq", halo).over(w),
    })).select("seq", "rn", F.round("total", 9).alias("total"), "back")
    base, p = plain(rows)
    want = base.select(
        "seq", F.row_number().over(p).cast("long").alias("rn"),
        F.round(F.sum("x").over(p.rowsBetween(-halo, 0)), 9).alias("total"), F.lag("seq", halo).over(p).alias("back"))
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty()


def test_large_key_is_split(rows):
    pieces = O.spread(rows, ["k"], O.time_bucket("t", 1000), 60, 10)
    sizes = pieces.groupBy("k", O.PIECE).count()
    # A burst within one clock cell stays together; everything else keeps to the target.
    assert sizes.filter("k = 1").count() > 15
    assert sizes.agg(F.max("count")).first()[0] < 600


def test_ranked(rows):
    got = O.ranked(rows, ["k"], ["t", "seq"], O.time_bucket("t", 1000), "rn", "n")
    base, p = plain(rows)
    want = base.select("seq", F.row_number().over(p).cast("long").alias("rn"), F.count("seq").over(Window.partitionBy("k")).alias("n"))
    assert got.select("seq", "rn", "n").exceptAll(want).isEmpty()


def test_carry_forward(rows):
    sparse = rows.filter("k is not null").withColumn("x", F.when(F.col("seq") % 11 == 0, F.col("x")))
    got = O.carry_forward(sparse, ["k"], ["t", "seq"], O.time_bucket("t", 1000), ["x"]).select("seq", "x")
    p = Window.partitionBy("k").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = sparse.select("seq", F.last("x", ignorenulls=True).over(p).alias("x"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(rows, descending):
    counts = rows.filter("k is not null").groupBy("k", F.round("x", 1).alias("s")).agg(F.count("*").alias("n"))
    got = O.running_totals(counts, ["k"], "s", ["n"], descending).select("k", "s", "upto_n", "total_n")
    w = Window.partitionBy("k").orderBy(F.desc("s") if descending else F.asc("s")).rowsBetween(Window.unboundedPreceding, 0)
    want = counts.select("k", "s", F.sum("n").over(w).alias("upto_n"), F.sum("n").over(Window.partitionBy("k")).alias("total_n"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_size_checked(spark):
    df = spark.range(10)
    assert O.size_checked(df, 20)[1] == 10
    same, n = O.size_checked(df, 5)
    assert same is df and n == 6
