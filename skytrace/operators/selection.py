"""Exact order statistics per group by distributed radix selection.

A group's values are counted in ``FANOUT`` equal intervals between its least and greatest. The counts, combined
before the shuffle, say which interval holds a wanted rank and how many values lie before it; only the
values of that interval go on, with its own least and greatest as the next bounds. Once an interval has at most ``FEW``
values, or equal ones, the rank is read off. So no group is sorted or gathered, and what is shuffled are
interval counts: two rounds reach groups of ``FANOUT * FEW`` evenly spread values, and each further one
divides what is left. Least and greatest never share an interval, so every round makes progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytrace.operators.ordered import size_checked
from skytrace.session import cut_lineage, stored

FANOUT = 4096
FEW = 4096


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> list[Column]:
    return [left[c].eqNullSafe(right[f"_r_{c}"]) for c in on]


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join; without keys ``right`` is one row."""
    if not on:
        return left.join(F.broadcast(right), how="cross") if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    return left.join(named, _same(left, named, on), how).drop(*[f"_r_{c}" for c in on])


def _in_ranges(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in a wanted interval of their group, with its bounds. A group's intervals are equal or disjoint."""
    ranges = targets.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    if by:
        ranges, _ = size_checked(ranges)
    found = _joined(rows, ranges, by).withColumn("_in", F.filter("_ranges", lambda r: F.col("_v").between(r["lo"], r["hi"])))
    return found.filter(F.size("_in") > 0).select(*by, "_v", F.get("_in", F.lit(0))["lo"].alias("lo"), F.get("_in", F.lit(0))["hi"].alias("hi"))


def _interval(fanout: int) -> Column:
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    at = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)  # halves: the difference can't overflow
    inner = F.least(F.floor(at * fanout), F.lit(fanout - 2))
    inner = F.greatest(F.coalesce(F.when(F.isnan(at), None).otherwise(inner), F.lit(1)), F.lit(0)).cast("long")
    # ends apart, whatever the arithmetic says
    return F.when(v == hi, F.lit(fanout - 1)).when(v == lo, F.lit(0)).otherwise(inner).cast("long")


def _narrowed(rows: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """Targets ``(by, tag, rank, lo, hi, n)`` with the bounds and size of the interval that holds their rank."""
    counts = _in_ranges(rows, targets, by).groupBy(*by, "lo", _interval(FANOUT).alias("_i")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    before = Window.partitionBy(*by, "lo").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)  # FANOUT rows at most
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    at = counts.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("lo").alias("_of"), "_lo", "_hi", "_c", "_before")
    same = [targets[c].eqNullSafe(at[f"_r_{c}"]) for c in by] + [targets["lo"] == at["_of"]]
    inside = (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_c"))
    return targets.join(at, same).filter(inside).select(
        *by, "tag", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_c").alias("n"))


def order_statistics(rows: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """``(by, tag, value)`` for ``targets(by, tag, rank, lo, hi, n)``: the value of 0-based ``rank`` among a group's ``_v``.

    ``lo``, ``hi`` and ``n`` are the group's least and greatest value and its size.
    """
    settled = (F.col("n") <= FEW) | (F.col("lo") == F.col("hi"))
    done = []
    while True:
        targets = cut_lineage(targets)  # a few rows a group
        done.append(targets.filter(settled))
        targets = targets.filter(~settled)
        if targets.isEmpty():
            break
        targets = _narrowed(rows, targets, by)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = cut_lineage(found)
    equal = found.filter("lo = hi").select(*by, "tag", F.col("lo").alias("value"))
    few = found.filter("lo < hi")
    if few.isEmpty():
        return equal
    lists = _in_ranges(rows, few, by).groupBy(*by, "lo").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    lists = lists.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("lo").alias("_of"), "_all")
    same = [few[c].eqNullSafe(lists[f"_r_{c}"]) for c in by] + [few["lo"] == lists["_of"]]
    read = few.join(lists, same).select(*by, "tag", F.get("_all", F.col("rank").cast("int")).alias("value"))
    return equal.unionByName(read)


def percentiles(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Per group: ``n``, ``min``, ``mean``, ``max`` and exact percentiles by linear interpolation.

    NULL values don't count, NaN counts as infinite. Without groups there is one row, NULLs if there are no values.
    """
    by = list(by)
    v = F.col(value).cast("double")
    rows = stored(df.select(*by, F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v).alias("_v")).filter("_v IS NOT NULL"), "values")
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.avg("_v").alias("mean"), F.max("_v").alias("max"))
    base = cut_lineage(base)  # a row a group
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ends = [F.struct(F.lit(f"{name}_{end}").alias("tag"), fn(place(q)).cast("long").alias("rank"))
            for name, q in quantiles.items() for end, fn in (("lo", F.floor), ("hi", F.ceil))]
    targets = base.filter("n > 0").select(*by, F.explode(F.array(*ends)).alias("t"), F.col("min").alias("lo"), F.col("max").alias("hi"), "n")
    found = order_statistics(rows, by, targets.select(*by, "t.tag", "t.rank", "lo", "hi", "n"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(f"_{t}") for name in quantiles for t in (f"{name}_lo", f"{name}_hi")])
    part = lambda q: place(q) - F.floor(place(q))
    lo, hi = (lambda name: F.col(f"_{name}_lo")), (lambda name: F.col(f"_{name}_hi"))
    between = lambda name, q: F.when(part(q) == 0, lo(name)).otherwise(lo(name) + (hi(name) - lo(name)) * part(q))
    return _joined(base, wide, by, "left").select(*by, "n", "min", "mean", "max", *[between(k, q).alias(k) for k, q in quantiles.items()])
