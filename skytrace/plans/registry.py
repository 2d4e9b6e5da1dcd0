"""The list of registered queries: name, operator ids, Spark function, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skytrace.plans.views import oracle


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None, raw: bool = False, runs: bool = False, pred: bool = False, recursive: bool = False):
    """Register a function under its own name. ``raw`` SQL reads the tables directly."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = sql if sql is None or raw else oracle(sql, runs_view=runs, pred=pred, recursive=recursive)
        QUERIES[name] = Query(name, tuple(ids.split()), fn, text)
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals: comparable between engines whatever the order of summation."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})
