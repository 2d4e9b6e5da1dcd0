"""Attack labels for rows: interval match in list order, and run-level joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skytrace import fixed_values as fixed
from skytrace.functions.scalars import run_class

BUCKET_S = 3600.0


def _level(bucket_s: float) -> Column:
    """How often ``bucket_s`` must double until a window touches few buckets."""
    length = (F.col("end_epoch") - F.col("start_epoch")) / F.lit(float(bucket_s))
    return F.when(length > 1, F.ceil(F.log2(length))).otherwise(0).cast("int")


def window_lookup(windows: DataFrame, by: list[str] = (), bucket_s: float = BUCKET_S) -> DataFrame:
    """Windows per (run columns, drone, level, time bucket), each list sorted by ``window_idx``.

    Targets come as an array ``target_drones`` or, in long form, one ``drone_id`` per
    row. A list holds only the windows that touch one bucket of one drone. Buckets of level ``n`` are
    ``bucket_s * 2 ** n`` long and hold windows of up to this length, so a window is listed three times at most,
    whether it lasts a second or ten years.
    """
    if "target_drones" in windows.columns:
        windows = windows.withColumn("drone_id", F.explode(F.array_distinct("target_drones")))
    bucket = lambda c: F.floor(F.col(c) / (F.lit(float(bucket_s)) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    return (
        windows.filter(F.col("start_epoch") <= F.col("end_epoch"))
        .select(*by, "window_idx", "start_epoch", "end_epoch", "attack_type",
                F.col("drone_id").cast("long").alias("drone_id"))
        .withColumn("_level", _level(bucket_s))
        .withColumn("_bucket", F.explode(F.sequence(bucket("start_epoch"), bucket("end_epoch"))))
        .groupBy(*by, "drone_id", "_level", "_bucket")
        .agg(F.sort_array(F.collect_list(
            F.struct("window_idx", "start_epoch", "end_epoch", "attack_type"))).alias("_windows"))
    )


def label_rows(
    df: DataFrame,
    windows: DataFrame,
    time: str | Column = "frame_timestamp",
    by: list[str] = (),
    bucket_s: float = BUCKET_S,
    out: str = "attack_type",
) -> DataFrame:
    """First window in list order that covers the row's time and targets its drone.

    Both bounds count as inside; a NULL drone gets NULL. The match is one left equi-join on (run columns,
    drone, time bucket) for each level of window length that occurs (:func:`window_lookup`), one where windows are of
    similar length. It never multiplies rows, so there is no grouping by row afterwards. No broadcast is
    forced: Spark broadcasts the lookup while it is below its own size limit and joins by shuffle beyond it.
    Rows of a NULL drone can match nothing and are spread instead of meeting in one task.
    """
    t = F.col(time) if isinstance(time, str) else time
    valid = windows.filter(F.col("start_epoch") <= F.col("end_epoch"))
    levels = sorted(r[0] for r in valid.select(_level(bucket_s)).distinct().collect())  # one a doubling of the length
    look = window_lookup(windows, list(by), bucket_s)
    rows = df.drop(out).withColumn("_t", t.cast("double"))
    found = []
    for level in levels or [0]:
        width = float(bucket_s) * 2.0**level
        right = look.filter(F.col("_level") == level).drop("_level")
        keys = [*by, "drone_id", "_bucket"]
        right = right.withColumnsRenamed({**{k: f"_w_{k}" for k in keys}, "_windows": f"_windows_{level}"})
        bucket = F.floor(F.col("_t") / F.lit(width)).cast("long")
        # a row without a drone joins on NULL, which equals nothing, and is dealt out by its time
        cond = [rows[k] == right[f"_w_{k}"] for k in keys[:-1]] + [bucket == right["_w__bucket"]]
        rows = rows.join(right, cond, "left").drop(*[f"_w_{k}" for k in keys])
        found.append(F.coalesce(F.col(f"_windows_{level}"), F.array().cast(look.schema["_windows"].dataType)))
    listed = found[0] if len(found) == 1 else F.sort_array(F.concat(*found))
    inside = F.filter(listed, lambda w: F.col("_t").between(w["start_epoch"], w["end_epoch"]))
    label = F.try_element_at(F.transform(inside, lambda w: w["attack_type"]), F.lit(1))
    return rows.withColumn(out, label).drop("_t", *[f"_windows_{v}" for v in levels or [0]])


def with_constant_label(df: DataFrame, value: str = fixed.NULL_TEXT) -> DataFrame:
    """An imported run carries one label; an existing column is overwritten."""
    return df.withColumn("attack_type", F.lit(value))


def with_run_class(runs: DataFrame) -> DataFrame:
    return runs.withColumn("run_label", run_class("attack"))


def attach_runs(df: DataFrame, runs: DataFrame, key: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """Rows of labelled runs with their run columns, and the run keys that had none."""
    labelled = df.join(runs, key, "inner")
    dropped = df.select(key).distinct().join(runs.select(key), key, "left_anti")
    return labelled, dropped


def exclude_seen(runs: DataFrame, manifest: DataFrame, name: str = "run_name") -> DataFrame:
    """Runs whose base name is in none of the manifest's train, val and test lists."""
    listed = F.array_compact(F.concat(*[
        F.coalesce(c, F.array().cast("array<string>")) for c in ("train_runs", "val_runs", "test_runs")
    ]))
    seen = manifest.select(F.explode(listed).alias("_path")).select(
        F.regexp_extract("_path", r"([^/]+)/*$", 1).alias(name)
    ).distinct()
    return runs.join(seen, name, "left_anti")


def whitelist(runs: DataFrame, names: list[str] | DataFrame, name: str = "run_name") -> DataFrame:
    if isinstance(names, DataFrame):
        return runs.join(names.select(name), name, "left_semi")
    return runs.filter(F.col(name).isin(list(names)))


def attach_dictionary(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Message name and field list by message id; unknown ids keep NULL."""
    return df.join(dictionary, "msgid", "left")
