"""Session helpers: a local session for tests and benches, shared scratch space."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", name: str = "skytrace", memory: str = "8g") -> SparkSession:
    """A small local session. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """Captured clocks have no zone; all epoch arithmetic here is in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df, label: str):
    """The rows as a Parquet table in the shared folder: computed once, later reads prune columns."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Deletes the table of :func:`stored` that ``df`` reads, once nothing needs it any more.

    Only folders this library made in the shared folder are ever deleted.
    """
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        drop_scratch(df.sparkSession, folder)


def drop_scratch(spark: SparkSession, folder: str) -> None:
    """Deletes a folder named by :func:`scratch_path`, and no other."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    shared = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    made = re.fullmatch(r"[a-z]+-[0-9a-f]{32}", path.getName())
    if made and files.makeQualified(path).getParent() == files.makeQualified(shared):
        files.delete(path, True)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder, so a lost executor costs no recompute chain."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession, fallback: int = 200) -> int:
    """The configured number of shuffle partitions, for stages AQE should not coalesce."""
    configured = spark.conf.get("spark.sql.shuffle.partitions", str(fallback))
    return int(configured) if configured.isdigit() else fallback
