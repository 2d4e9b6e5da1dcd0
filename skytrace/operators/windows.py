"""Causal count windows over rows: records, tensors, flat-line flags, balancing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from skytrace import fixed_values as fixed
from skytrace.functions.scalars import is_labelled
from skytrace.operators.features import KEYS, MINUTE_MS, ORDER
from skytrace.operators.ordered import (
    OWN_PIECE, PIECE, TARGET_ROWS, order_by, own_rows, piece_window, row_number_in_key, size_checked, spread, time_bucket,
)
from skytrace.session import cut_lineage, stored


def training_rows(df: DataFrame, attack_rows: str = "labelled") -> DataFrame:
    """Rows a detector learns from, with ``y_true``; benign runs are 0 throughout.

    Attack runs give labelled rows only, or all rows with ``attack_rows="all"``.
    """
    if attack_rows not in ("labelled", "all"):
        raise ValueError(f"attack_rows must be 'labelled' or 'all', got {attack_rows!r}")
    benign = F.col("run_label") == "benign"
    labelled = is_labelled("attack_type")
    rows = df if attack_rows == "all" else df.filter(benign | labelled)
    return rows.withColumn("y_true", F.when(benign, 0).otherwise(labelled.cast("int")))


def _numbered(df: DataFrame, keys: list[str], order: list[str], halo: int, target_rows: int) -> DataFrame:
    pieces = spread(df, keys, time_bucket(order[0], MINUTE_MS), max(target_rows, halo), halo)
    return pieces.withColumn("_rn", row_number_in_key(keys, order))


def _is_end(size: int, stride: int):
    return (F.col("_rn") >= size) & ((F.col("_rn") - size) % stride == 0)


def causal_windows(
    df: DataFrame,
    size: int = fixed.WINDOW_SIZE,
    stride: int = fixed.STRIDE,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    keep: list[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One record per window of ``size`` rows ending every ``stride`` rows.

    The last row labels the window. ``keep`` names columns of that last row to carry.
    """
    keys, order = keys or KEYS, order or ORDER
    clock = F.coalesce(F.col(order[0]).try_cast("double"), F.lit(0.0))
    numbered = _numbered(df, keys, order, size - 1, target_rows)
    begun = F.lag(clock, size - 1).over(piece_window(keys, order)) if size > 1 else clock
    ends = own_rows(numbered.withColumn("_begun", begun).filter(_is_end(size, stride)))
    return ends.select(
        *keys,
        F.floor((F.col("_rn") - size) / stride).cast("long").alias("window_index"),
        (F.col("_rn") - size).alias("row_start_index"),
        F.col("_rn").alias("row_end_index"),
        F.col("_begun").alias("window_start_timestamp"),
        clock.alias("window_end_timestamp"),
        *keep,
    )


def window_tensors(
    df: DataFrame,
    cols: list[str],
    size: int = fixed.WINDOW_SIZE,
    stride: int = fixed.STRIDE,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    keep: list[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Windows as ``size`` x ``len(cols)`` float arrays.

    One pass over the numbered rows in Arrow batches: a strided view over the batch and the ``size - 1`` rows before it
    holds all windows, and only those that end on the stride are copied out. NULL cells stay NULL.
    """
    keys, order, cols, keep = keys or KEYS, order or ORDER, list(cols), list(keep)
    carried = list(dict.fromkeys([*keys, *keep]))
    values = [F.col(c).cast("float").alias(f"_x{i}") for i, c in enumerate(cols)]
    numbered = _numbered(df, keys, order, size - 1, target_rows)
    end = (F.col(PIECE) == F.col(OWN_PIECE)) & _is_end(size, stride)
    # the numbering's own order; a piece begins with the rows its first window needs
    rows = numbered.sortWithinPartitions(*keys, PIECE, *order_by(order)).select(
        *carried, F.floor((F.col("_rn") - size) / stride).cast("long").alias("window_index"), end.alias("_end"), *values)
    shown = df.select(*carried).schema
    schema = StructType([*[shown[c] for c in keys], StructField("window_index", LongType()), *[shown[c] for c in keep],
                         StructField("tensor", ArrayType(ArrayType(FloatType())))])
    return rows.mapInArrow(_strided(size, len(cols), [*keys, "window_index", *keep]), schema)


def _strided(size: int, width: int, columns: list[str]):
    def lists(flat: pa.Array, step: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, step, dtype=np.int32)), flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.empty((0, width), np.float32)
        gaps = np.empty((0, width), bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [batch.column(f"_x{i}") for i in range(width)]
            x = np.concatenate([tail, np.column_stack([c.to_numpy(zero_copy_only=False) for c in cells]).astype(np.float32, copy=False)])
            gap = np.concatenate([gaps, np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in cells])])
            ends = np.flatnonzero(batch.column("_end").to_numpy(zero_copy_only=False).astype(bool))
            if len(ends):
                view, holes = (np.lib.stride_tricks.sliding_window_view(v, size, axis=0) for v in (x, gap))
                block = max(1, (1 << 20) // (size * width))  # about a million cells at a time
                for k in range(0, len(ends), block):
                    some = ends[k : k + block]
                    at = some + len(tail) - size + 1
                    flat = pa.array(view[at].transpose(0, 2, 1).ravel(), mask=holes[at].transpose(0, 2, 1).ravel())
                    rows = pa.array(some)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(rows) for c in columns], lists(lists(flat, width), size)], [*columns, "tensor"])
            held = min(size - 1, len(x))
            tail, gaps = x[len(x) - held :], gap[len(x) - held :]

    return run


def tensor_steps(tensors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Long form of a tensor frame: one row per (window, step)."""
    keys = keys or KEYS
    return tensors.select(*keys, "window_index", F.posexplode("tensor").alias("step", "features"))


def flat_line(
    df: DataFrame,
    cols: list[str],
    size: int = fixed.WINDOW_SIZE,
    stride: int = fixed.STRIDE,
    threshold: float = fixed.FLAT_LINE_THRESHOLD,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Windows with a flag for "no listed column moved by ``threshold`` or more"."""
    keys, order = keys or KEYS, order or ORDER
    numbered = _numbered(df, keys, order, size - 1, target_rows)
    frame = piece_window(keys, order).rowsBetween(-(size - 1), 0)
    still = F.lit(True)
    for c in cols:
        still = still & (F.max(c).over(frame) - F.min(c).over(frame) < threshold)
    ends = own_rows(numbered.withColumn("frozen", still).filter(_is_end(size, stride)))
    return ends.select(
        *keys, F.floor((F.col("_rn") - size) / stride).cast("long").alias("window_index"), "frozen"
    )


def _draw(seed: int, cols: list[str]):
    """A uniform text key per row: equal input gives equal order, whatever the layout."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))), 256)


def undersample(
    windows: DataFrame, seed: int = fixed.SPLIT_SEED, id_cols: list[str] | None = None,
    label: str = "y_true", shuffle: bool = False,
) -> DataFrame:
    """Equal class sizes by dropping majority windows at random, without replacement.

    The draw is the order of a seeded hash of the window's identity. Windows are counted
    per hash prefix; whole prefixes below the cut are kept where they are, and only the
    windows of the one prefix that holds the cut are ranked. So neither a class nor the
    table is shuffled. Nothing is dropped when a class is absent. The windows are computed once and
    stored; the three steps read the stored table.
    """
    id_cols = id_cols or [*KEYS, "window_index"]
    drawn = windows.withColumn("_draw", _draw(seed, id_cols)).withColumn("_prefix", F.substring("_draw", 1, 4))
    drawn = stored(drawn, "windows")
    # At most 65536 prefixes per class, whatever the table size.
    counts = cut_lineage(drawn.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("_size"))
    quota = sizes.agg(F.when(F.count(F.lit(1)) > 1, F.min("_size")).alias("_quota"))
    upto = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    after, n, cap = F.col("_after"), F.col("_n"), F.col("_quota")
    here = (after - n < cap) & (after > cap)
    limits, _ = size_checked(
        counts.withColumn("_after", F.sum("_n").over(upto)).crossJoin(F.broadcast(quota))  # one row
        .groupBy(label).agg(
            F.max(F.when(cap.isNull() | (after <= cap), F.col("_prefix"))).alias("_last"),
            F.max(F.when(here, F.col("_prefix"))).alias("_cut"),
            F.max(F.when(here, cap - after + n)).alias("_rest"),
        )
    )
    placed = drawn.join(limits, label)
    whole = placed.filter(F.col("_prefix") <= F.col("_last"))
    within = Window.partitionBy(label, "_prefix").orderBy("_draw", *id_cols)
    edge = (
        placed.filter(F.col("_prefix") == F.col("_cut"))
        .withColumn("_rank", F.row_number().over(within)).filter("_rank <= _rest").drop("_rank")
    )
    kept = whole.unionByName(edge)
    if shuffle:
        kept = kept.orderBy(_draw(seed + 1, id_cols))
    return kept.drop("_draw", "_prefix", "_last", "_cut", "_rest")


def class_distribution(windows: DataFrame, split: str = "split", label: str = "y_true") -> DataFrame:
    pivot = windows.groupBy(split).pivot(label, [0, 1]).agg(F.count(F.lit(1)))
    return pivot.select(
        split, F.coalesce("0", F.lit(0)).alias("benign"), F.coalesce("1", F.lit(0)).alias("attack")
    )


def class_weights(windows: DataFrame, label: str = "y_true") -> DataFrame:
    """``total / (2 * n)`` per class, 1.0 for an absent one."""
    counts = windows.agg(
        F.count_if(F.col(label) == 0).alias("_n0"), F.count_if(F.col(label) == 1).alias("_n1")
    )
    total = (F.col("_n0") + F.col("_n1")).cast("double")
    weight = lambda n: F.coalesce(F.try_divide(total, 2.0 * F.col(n)), F.lit(1.0))
    return counts.select(F.explode(F.array(
        F.struct(F.lit(0).alias("label"), F.col("_n0").alias("n"), weight("_n0").alias("weight")),
        F.struct(F.lit(1).alias("label"), F.col("_n1").alias("n"), weight("_n1").alias("weight")),
    )).alias("c")).select("c.*")
