"""Set operations on drone and run lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def skipped(all_ids: DataFrame, ready: DataFrame) -> DataFrame:
    return all_ids.subtract(ready)


def effective_targets(flying: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Requested drones that fly; without a request all that fly."""
    return flying.distinct() if requested is None else requested.intersect(flying)


def zero_window_only(zero: DataFrame, below: DataFrame) -> DataFrame:
    return zero.subtract(below)


def concat_runs(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
