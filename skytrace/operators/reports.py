"""The canned flight report and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skytrace import fixed_values as fixed
from skytrace.functions.scalars import is_labelled, num, primary


def volume(df: DataFrame) -> DataFrame:
    per_drone = df.groupBy("drone_id").agg(F.count(F.lit(1)).alias("n"))
    return per_drone.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("drone_id").alias("drones")
    )


def drone_stats(df: DataFrame) -> DataFrame:
    per_drone = df.groupBy("drone_id").agg(F.count(F.lit(1)).alias("c"))
    return per_drone.agg(
        F.min("c").alias("min_rows"), F.round(F.avg("c"), 0).alias("mean_rows"), F.max("c").alias("max_rows")
    )


def label_histogram(df: DataFrame) -> DataFrame:
    counts = df.groupBy("attack_type").agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.desc("rows"), F.asc_nulls_last("attack_type"))


def top_types(df: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent message types with rows per drone, rounded half to even.

    Counting per (type, drone) first replaces the distinct count: one partial
    aggregation on the map side, then a few rows per type.
    """
    per_drone = (
        df.filter(F.col("mav_packet_type").isNotNull())
        .groupBy("mav_packet_type", "drone_id").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = per_drone.groupBy("mav_packet_type").agg(
        F.sum("n").alias("total"), F.count("drone_id").alias("drones")
    )
    ratio = F.try_divide(F.col("total").cast("double"), F.col("drones").cast("double"))
    return (
        totals.select("mav_packet_type", "total", F.rint(ratio).cast("int").alias("per_drone"))
        .orderBy(F.desc("total"), "mav_packet_type").limit(k)
    )


def hud_dynamics(df: DataFrame) -> DataFrame:
    speed, alt = num("groundspeed", "float"), num("alt", "float")
    return primary(df, "VFR_HUD").groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.max(speed).cast("double"), 2).alias("max_spd_ms"),
        F.round(F.avg(speed), 2).alias("mean_spd_ms"),
        F.round(F.max(alt).cast("double"), 1).alias("max_alt_m"),
    ).orderBy("attack_type")


def attitude_dynamics(df: DataFrame) -> DataFrame:
    peak = lambda c: F.round(F.max(F.abs(num(c, "float"))).cast("double") * fixed.RADIANS_TO_DEGREES, 1)
    return primary(df, "ATTITUDE").groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("rows"),
        peak("roll").alias("max_roll_deg"),
        peak("pitch").alias("max_pitch_deg"),
    ).orderBy("attack_type")


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("mav_packet_type").agg(F.count(F.lit(1)).alias("rows"))


def label_coverage(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Labelled rows per run; an attack run without any raises ``alert``."""
    per_run = df.groupBy("run_id").agg(
        F.count_if(is_labelled("attack_type")).alias("labelled_rows"), F.count(F.lit(1)).alias("rows")
    )
    labelled = F.coalesce("labelled_rows", F.lit(0))
    return runs.join(per_run, "run_id", "left").select(
        "run_id", "run_label", labelled.alias("labelled_rows"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        ((F.col("run_label") == "attack") & (labelled == 0)).alias("alert"),
    )


def report_header(runs: DataFrame) -> DataFrame:
    """One line per run from its metadata; absent entries show as ``?`` or 0."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    length = lambda c: F.coalesce(F.size(c), F.lit(0))
    return runs.select(
        "run_name", text("attack").alias("attack"), text("swarm_size").alias("swarm_size"),
        text("start_s").alias("start_s"), text("end_s").alias("end_s"),
        F.greatest(length("ready_drones"), F.lit(0)).alias("ready"),
        F.greatest(length("skipped_drones"), F.lit(0)).alias("skipped"),
        F.greatest(length("attack_targets"), F.lit(0)).alias("targets"),
    )


def canned_report(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "volume": volume(df), "drone_stats": drone_stats(df), "label_histogram": label_histogram(df),
        "top_types": top_types(df), "hud_dynamics": hud_dynamics(df),
        "attitude_dynamics": attitude_dynamics(df),
    }
