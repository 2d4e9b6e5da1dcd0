"""Text logs: training reports, stage timings, archived flight logs, sweep summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skytrace import fixed_values as fixed
from skytrace.sources.capture import _files

_METRICS = ("precision", "recall", "f1", "support")


def train_metrics(text: Column) -> list[Column]:
    """Attack-class metrics of the first (validation) and second (test) report, and the threshold."""
    pattern = F.lit(fixed.TRAIN_LOG_METRIC_PATTERN)
    out = []
    for i, part in enumerate(("val", "test"), start=1):
        for g, name in enumerate(_METRICS, start=1):
            found = F.try_element_at(F.regexp_extract_all(text, pattern, g), F.lit(i))
            out.append(found.try_cast("int" if name == "support" else "double").alias(f"{part}_attack_{name}"))
    threshold = F.regexp_extract(text, fixed.TRAIN_LOG_THRESHOLD_PATTERN, 1)
    return [*out, threshold.try_cast("double").alias("best_threshold")]


def parse_train_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file, tagged by its file name. A log is one training run's console text."""
    logs = spark.read.text(path, wholetext=True)
    tag = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.log$", 1)
    return logs.select(tag.alias("tag"), *train_metrics(F.col("value")))


def stage_steps(lines: DataFrame, line: str = "value") -> DataFrame:
    part = lambda i: F.regexp_extract(line, fixed.STAGE_LOG_PATTERN, i)
    return lines.filter(F.col(line).rlike(fixed.STAGE_LOG_PATTERN)).select(
        part(1).alias("stage"), part(2).cast("int").alias("instance"),
        part(3).alias("step"), part(4).cast("double").alias("elapsed_s"),
    )


def parse_stage_logs(spark: SparkSession, path: str) -> DataFrame:
    return stage_steps(spark.read.text(path))


def stage_timing(steps: DataFrame) -> DataFrame:
    return steps.groupBy("stage", "step").agg(
        F.count(F.lit(1)).alias("n"), F.avg("elapsed_s").alias("mean_s"), F.max("elapsed_s").alias("max_s")
    )


def log_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Archived flight logs with size in MB, and a last row with the total."""
    files = _files(spark, path, "*.BIN").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length"
    )
    mb = (F.sum("length") / F.lit(1_048_576.0)).alias("size_mb")
    return (
        files.groupingSets([["name"], []], "name")
        .agg(F.grouping("name").alias("is_total"), mb).orderBy("is_total", "name")
    )


def write_sweep_summary(collated: DataFrame, out: str) -> None:
    """Sweep results as one CSV; a sweep has tens of rows."""
    collated.coalesce(1).write.option("header", "true").mode("overwrite").csv(out)
