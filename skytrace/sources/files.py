"""Small files of a given name, through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes one small file from the driver: logs and the like, never rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
