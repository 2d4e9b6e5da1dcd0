"""Column expressions on texts, built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


BLOCK = 1024  # code points per block of a text
RUN = 256  # values per run of a running total


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """``step`` carried over longs from left to right, starting at 0: the value after each element.

    Appending copies what is there, so it is done within runs of ``RUN`` values and once over the runs.
    ``step`` is associative, with 0 as its neutral value.
    """

    def appended(items: Column) -> Column:
        last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))
        return F.aggregate(items, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(step(last(acc), x))))

    def over(all_values: Column) -> Column:
        firsts = F.sequence(F.lit(0), F.greatest(F.size(all_values) - 1, F.lit(0)), F.lit(RUN))
        return F.transform(firsts, lambda k: appended(F.slice(all_values, k + 1, F.lit(RUN))))

    def joined(runs: Column) -> Column:
        ends = appended(F.transform(runs, lambda r: F.coalesce(F.get(r, F.size(r) - 1), F.lit(0).cast("long"))))
        before = lambda e, i: F.coalesce(F.get(e, i - 1), F.lit(0).cast("long"))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: F.transform(r, lambda x: step(before(e, i), x)))))

    return let(let(values, over), joined)


def blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0) on; the cost doesn't depend on where in the text that is."""
    first = F.floor(start / BLOCK)
    some = F.slice(pieces, (first + 1).cast("int"), (F.floor((start + size - 1) / BLOCK) - first + 1).cast("int"))
    return F.substring(F.array_join(some, ""), (start % BLOCK + 1).cast("int"), size.cast("int"))


def found(text: Column, pattern: str) -> Column:
    """Matches from left to right as ``array<struct<m, start>>``; start counts code points from 0."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(p: Column, h: Column) -> Column:
        ends = running(F.transform(h, lambda m, i: (F.length(F.get(p, i)) + F.length(m)).cast("long")), lambda a, x: a + x)
        return let(ends, lambda e: F.transform(h, lambda m, i: F.struct(m.alias("m"), (F.get(e, i) - F.length(m)).alias("start"))))

    return let(hits, lambda h: F.when(F.size(h) > 0, let(pieces, lambda p: placed(p, h))).otherwise(
        F.array().cast("array<struct<m:string,start:long>>")
    ))
