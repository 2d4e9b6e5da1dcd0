"""Helpers for jobs of several steps: stored tables, and Arrow work on small groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.textbytes import mix
from skytrace.session import scratch_path


def stored(df: DataFrame, label: str, compression: str = "snappy", tasks: int = 0) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors.

    With ``tasks`` the last stage has so many tasks and files at most; each takes several partitions in turn.
    """
    path = scratch_path(df.sparkSession, label)
    (df.coalesce(tasks) if tasks else df).write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_limit(table: DataFrame) -> int:
    """Tasks for a stage over data of the size of ``table``, a stored one: four for each core, or its own splits if more."""
    return max(4 * table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())


def likely(rows: DataFrame, column: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """``rows`` without most of those whose ``column`` (a long) is in no row of ``ids(id)``: for a join that follows.

    Ids are marked in a field of ``2 ** bits`` bits, made as 64-bit words before anything comes to the driver.
    """

    def spots(values: pa.Array) -> np.ndarray:
        return (mix(values.fill_null(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def words(batches):
        for batch in batches:
            p = np.unique(spots(batch.column("id")))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array(long_keys(np.uint64(1) << (p & 63).astype(np.uint64)))], ["w", "b"])

    marked = ids.select(ids.columns[0]).toDF("id").mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    field = np.zeros(1 << (bits - 6), np.int64)
    field[marked.column("w").to_numpy()] = marked.column("b").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        has = shared.value.view(np.uint64)
        for batch in batches:
            p = spots(batch.column(column))
            yield batch.filter(pa.array((has[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return rows.mapInArrow(run, rows.schema)


def map_groups(
    df: DataFrame, key: str, work: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, tasks: int = 0
) -> DataFrame:
    """``work(rows, bounds)`` over runs of rows with equal ``key`` (a non-null long).

    Many groups come in one call; group ``i`` is ``rows[bounds[i]:bounds[i + 1]]``. For groups of
    bounded size only: a group is held in memory whole. ``tasks`` as in :func:`stored`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(table: pa.Table):
            keys = table.column(key).to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            out = work(table, bounds)
            if out is not None and out.num_rows:
                yield out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            if held and held[-1].column(key)[-1].as_py() != keys[0]:
                yield from worked(pa.Table.from_batches(held))
                held = []
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield from worked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from worked(pa.Table.from_batches(held))

    dealt = df.repartition(key).sortWithinPartitions(key)
    return (dealt.coalesce(tasks) if tasks else dealt).mapInArrow(run, schema)


def fixed_bytes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]).reshape(len(column), width)


def to_binary(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, a row each."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    flat = pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)])
    return flat.cast(pa.binary())


def long_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark longs."""
    return values.astype(np.uint64).view(np.int64)
