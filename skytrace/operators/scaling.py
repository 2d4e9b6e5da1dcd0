"""Standard scaling with population deviation, fitted on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fit_scaler(df: DataFrame, cols: list[str], scope: str = "train_all") -> DataFrame:
    """One row ``(cols, mean, scale)`` of arrays; a zero deviation scales by 1."""
    if scope not in ("train_all", "train_benign"):
        raise ValueError(f"unknown scaler scope {scope!r}")
    rows = df.filter(F.col("run_label") == "benign") if scope == "train_benign" else df
    std = lambda c: F.stddev_pop(c)
    stats = rows.agg(F.array(*[F.avg(c) for c in cols]).alias("mean"),
                     F.array(*[std(c) for c in cols]).alias("scale"))
    unit = lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s)
    return stats.select(
        F.array(*[F.lit(c) for c in cols]).alias("cols"), "mean", F.transform("scale", unit).alias("scale")
    )


def apply_scaler(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - mean) / scale`` for each column. The statistics are one row, so broadcast is safe."""
    joined = df.crossJoin(F.broadcast(stats.select(F.col("mean").alias("_m"), F.col("scale").alias("_s"))))
    scaled = {c: (F.col(c) - F.col("_m")[i]) / F.col("_s")[i] for i, c in enumerate(cols)}
    return joined.withColumns(scaled).drop("_m", "_s")


def scaler_table(stats: DataFrame) -> DataFrame:
    """Long form: one row per feature."""
    return stats.select(F.explode(F.arrays_zip("cols", "mean", "scale")).alias("z")).select(
        F.col("z.cols").alias("feature"), "z.mean", "z.scale"
    )
