"""Order-dependent work on keys of any size.

One vehicle, run or class may hold a large share of all rows. A window over such a
key alone would be one task, so the helpers here cut a key into consecutive pieces
and join small per-piece carry-overs:

``spread``        overlapping pieces of about equal row count (rolling and count windows)
``ranked``        exact row number and total per key
``carry_forward`` last known value per column as of each row
``running_totals`` exact prefix sums over a pre-aggregated score
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytrace.session import cut_lineage

TARGET_ROWS = 2_000_000
# Above this many rows a lookup is not broadcast but joined by shuffle.
BROADCAST_ROWS = 100_000
HOUR_MS = 3_600_000

PIECE, OWN_PIECE, ROWS_BEFORE = "_piece", "_own_piece", "_rows_before"


def time_bucket(c: Column | str = "timestamp", width_ms: int = HOUR_MS) -> Column:
    """Bucket number of a millisecond clock; rows without a clock go last."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.floor(c.try_cast("double") / width_ms).cast("long"), F.lit(2**62))


def order_by(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def _keyed_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])


def size_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """``df`` as a broadcast when it proves to have at most ``limit`` rows, else unchanged.

    At most ``limit + 1`` rows reach the driver. The count is exact up to the limit.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, len(rows)
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), len(rows)


def _pieces(df: DataFrame, keys: list[str], cell: Column, target_rows: int, halo: int) -> DataFrame:
    """Which pieces each (key, cell) of a large key feeds; cells of a first piece alone do not appear."""
    counts = df.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long")
    own = F.floor(F.col(ROWS_BEFORE) / target_rows).cast("long")
    # A later piece needs this cell when its first row lies within `halo` rows of the
    # cell's end. Pieces start in distinct intervals of target_rows, so at most two do.
    after = F.col(ROWS_BEFORE) + F.col("_n")
    first = F.greatest(F.col(OWN_PIECE) + 1, F.floor(after / target_rows).cast("long"))
    last = F.floor((after + (halo - 1)) / target_rows).cast("long")
    fed = F.when((last >= first) & F.lit(halo > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return (
        counts.withColumn(ROWS_BEFORE, before)
        .withColumn(OWN_PIECE, own)
        .withColumn("_pieces", F.concat(F.array(OWN_PIECE), fed))
        .filter((F.col(OWN_PIECE) > 0) | (F.size("_pieces") > 1))
        .select(*keys, "_cell", ROWS_BEFORE, OWN_PIECE, "_pieces")
    )


def spread(
    df: DataFrame,
    keys: list[str],
    cell: Column,
    target_rows: int = TARGET_ROWS,
    halo: int = 0,
) -> DataFrame:
    """Cut every key into consecutive pieces of about ``target_rows`` rows; NULL is a key like others.

    ``cell`` must not decrease along the row order. Each piece also holds at least the
    ``halo`` rows before it, so a window over ``[*keys, "_piece"]`` sees all it needs.
    Adds ``_piece``, ``_own_piece`` and ``_rows_before``; keep a row's result where the
    two piece columns agree.

    A count per key, combined on the map side, finds the large keys. Without any, rows
    pass unchanged and the window's own shuffle stays the only one. Otherwise a second
    pass counts the cells of the large keys alone.
    """
    if halo > target_rows:
        raise ValueError("halo must not exceed target_rows")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # Never more than rows / target_rows keys, and checked besides.
    large, n = size_checked(sizes.filter(F.col("_n") > target_rows).select(*keys))
    if n == 0:
        zero = F.lit(0).cast("long")
        return df.withColumns({PIECE: zero, OWN_PIECE: zero, ROWS_BEFORE: zero})
    named = large.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    of_large = df.join(named, [df[c].eqNullSafe(named[f"_r_{c}"]) for c in keys], "left_semi")
    pieces, _ = size_checked(_pieces(of_large, keys, cell, target_rows, halo))
    joined = _keyed_join(df.withColumn("_cell", cell), pieces, [*keys, "_cell"])
    zero = F.lit(0).cast("long")
    return (
        joined.withColumns({
            PIECE: F.explode(F.coalesce("_pieces", F.array(zero))),
            OWN_PIECE: F.coalesce(OWN_PIECE, zero),
            ROWS_BEFORE: F.coalesce(ROWS_BEFORE, zero),
        })
        .drop("_cell", "_pieces")
    )


def piece_window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, PIECE).orderBy(*order_by(order))


def row_number_in_key(keys: list[str], order: list[str]) -> Column:
    """1-based row number within the whole key, on the output of ``spread``."""
    w = piece_window(keys, order)
    grown = w.rowsBetween(Window.unboundedPreceding, 0)
    return (F.min(ROWS_BEFORE).over(grown) + F.row_number().over(w)).cast("long")


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(PIECE) == F.col(OWN_PIECE)).drop(PIECE, OWN_PIECE, ROWS_BEFORE)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    rank: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Exact row number (and row count) per key, sorted only within (key, bucket)."""
    df = df.withColumn("_bucket", bucket)
    per_bucket = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")]
    if total:
        sizes.append(F.sum("_n").over(by_key).alias(total))
    offsets = per_bucket.select(*keys, "_bucket", *sizes)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order_by(order))
    return (
        _keyed_join(df, offsets, [*keys, "_bucket"])
        .withColumn(rank, (F.col("_before") + F.row_number().over(within)).cast("long"))
        .drop("_bucket", "_before")
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: list[str], firsts: dict[str, str] | None = None
) -> DataFrame:
    """Replace each column by its last non-null value up to the row, per key.

    Within a bucket the rows themselves give it; across buckets one summary row per
    bucket does. ``firsts`` adds columns with the first non-null value of another one in
    the key up to the end of the row's bucket.
    """
    firsts = firsts or {}
    df = df.withColumn("_bucket", bucket)
    at = F.struct(*order)
    seen = lambda c: F.when(F.col(c).isNotNull(), at)
    summary = df.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, seen(c)).alias(c) for c in cols], *[F.min_by(c, seen(c)).alias(n) for n, c in firsts.items()]
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    upto_bucket = by_bucket.rowsBetween(Window.unboundedPreceding, 0)
    carried = summary.select(
        *keys, "_bucket",
        *[F.last(c, ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in cols],
        *[F.first(n, ignorenulls=True).over(upto_bucket).alias(n) for n in firsts],
    )
    upto = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order_by(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = _keyed_join(df, carried, [*keys, "_bucket"])
    return joined.withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_c_{c}")) for c in cols
    }).drop("_bucket", *[f"_c_{c}" for c in cols])


def running_totals(
    counts: DataFrame, keys: list[str], score: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Prefix sums of ``sums`` along ``score`` within ``keys``, the row itself included.

    ``counts`` must hold one row per (keys, score). It is range partitioned by both, so
    no task holds a whole group, and written out with the partition number: three small
    reads follow, and the number must not change between them. ``total_<col>`` columns
    give the group sums.
    """
    by_range = counts.repartitionByRange(*keys, score).withColumn("_part", F.spark_partition_id())
    cut = cut_lineage(by_range)
    per_part = cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    part_order = F.col("_part").desc() if descending else F.col("_part").asc()
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col("_part").alias("_r__part"),
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(c).over(by_key).alias(f"total_{c}") for c in sums],
    )
    cond = [cut[k].eqNullSafe(offsets[f"_r_{k}"]) for k in keys]
    cond.append(cut["_part"] == offsets["_r__part"])
    score_order = F.col(score).desc() if descending else F.col(score).asc()
    within = (
        Window.partitionBy(*keys, "_part").orderBy(score_order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(offsets, cond, "inner")
        .withColumns({f"upto_{c}": F.col(f"_before_{c}") + F.sum(c).over(within) for c in sums})
        .drop("_part", "_r__part", *[f"_r_{k}" for k in keys], *[f"_before_{c}" for c in sums])
    )
