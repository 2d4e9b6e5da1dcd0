"""Preprocessed rows kept as Parquet under a fingerprint of their inputs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from skytrace import fixed_values as fixed
from skytrace.sources.capture import _files


def fingerprint(files: DataFrame, settings: dict[str, object]) -> DataFrame:
    """16 hex digits of settings and all ``(path, mtime, size)``, independent of order.

    Files are hashed one by one and combined as a tree over hash prefixes, so no task
    sees the whole list.
    """
    head = json.dumps({"version": fixed.CACHE_FORMAT_VERSION, **settings}, sort_keys=True)
    return fingerprint_of(files.select(F.concat_ws("|", "path", F.col("mtime").cast("string"), F.col("size").cast("string")).alias("entry")), head)


def fingerprint_of(entries: DataFrame, head: str) -> DataFrame:
    level = entries.select(F.sha2("entry", 256).alias("h"))
    for width in (4, 2, 0):
        joined = F.array_join(F.sort_array(F.collect_list("h")), "")
        level = level.groupBy(F.substring("h", 1, width).alias("_p")).agg(
            F.concat("_p" if width else F.lit(""), F.sha2(joined, 256)).alias("h")
        ).select("h")
    return level.select(F.substring(F.sha2(F.concat(F.lit(head), F.lit("|"), F.col("h")), 256), 1, 16).alias("fingerprint"))


def file_entries(spark: SparkSession, root: str, glob: str = "drone_*.csv") -> DataFrame:
    """Path, time and size; the time has the millisecond grain Spark's listing gives."""
    return _files(spark, root, glob).select(
        "path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")
    )


def cached(spark: SparkSession, root: str, key: str, builder: Callable[[], DataFrame], partition: str = "split") -> DataFrame:
    """The frame stored under ``key``, built and written first when absent.

    Rows lie under ``<key>/rows``. ``<key>/manifest`` is written after them, so an entry
    without it is unfinished and gets rebuilt.
    """
    rows, done = (f"{root.rstrip('/')}/{key}/{part}" for part in ("rows", "manifest"))
    if not _finished(spark, done):
        frame = builder()
        writer = frame.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition) if partition in frame.columns else writer).parquet(rows)
        entry = spark.range(1).select(
            F.lit(key).alias("cache_key"), F.lit(fixed.CACHE_FORMAT_VERSION).alias("format_version"),
            F.lit(json.dumps(sorted(frame.columns))).alias("columns"))
        entry.write.mode("overwrite").parquet(done)
    return spark.read.parquet(rows)


def _finished(spark: SparkSession, done: str) -> bool:
    try:
        return not spark.read.parquet(done).isEmpty()
    except AnalysisException:
        return False
