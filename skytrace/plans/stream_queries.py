"""Streaming operators run to completion over the ``events`` file and read back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window, functions as F

from skytrace.functions import scalars as S
from skytrace.operators.windows import training_rows
from skytrace.plans.feature_queries import POSES_ORACLE, poses
from skytrace.plans.registry import query, r6
from skytrace.plans.report_queries import _WINDOWS_SQL, attack_windows
from skytrace.plans.views import EVENTS_SCHEMA, STEP, WINDOW, flight, over_events
from skytrace.session import scratch_path, use_utc
from skytrace.streaming import live


def flight_stream(spark, d) -> DataFrame:
    """The telemetry view over ``events`` as a stream, with an event-time column ``ts``."""
    use_utc(spark)
    events = spark.readStream.schema(EVENTS_SCHEMA).option("maxBytesPerTrigger", str(1 << 30)).parquet(f"{d.rstrip('/')}/events*.parquet")
    return over_events(spark, events).withColumn("ts", F.timestamp_millis("timestamp"))


def _appended(sdf: DataFrame) -> DataFrame:
    """Run an append-mode stream over what is there and read its sink."""
    spark = sdf.sparkSession
    out, marks = scratch_path(spark, "sink"), scratch_path(spark, "marks")
    run = (sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


def _updated(sdf: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode stream; the last batch that touched a key holds its value."""
    spark = sdf.sparkSession
    out, marks = scratch_path(spark, "sink"), scratch_path(spark, "marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = (sdf.writeStream.foreachBatch(write).option("checkpointLocation", marks)
           .outputMode("update").trigger(availableNow=True).start())
    run.awaitTermination()
    batches = spark.read.parquet(out)
    rest = [c for c in sdf.columns if c not in keys]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


@query("ST1 S23", "WITH " + _WINDOWS_SQL.strip() + """
SELECT f.drone_id, f.seq, COALESCE((ARRAY_AGG(w.label ORDER BY w.window_idx) FILTER (WHERE w.label IS NOT NULL))[1], 'null') AS attack_type, f.timestamp
FROM flight f LEFT JOIN wins w ON w.run_id = f.run_id AND f.run_label = 'attack'
  AND f.frame_timestamp >= w.start_epoch AND f.frame_timestamp <= w.end_epoch
GROUP BY f.drone_id, f.seq, f.timestamp""")
def stream_labelled_capture(spark, d):
    sdf = flight_stream(spark, d).drop("timestamp")
    out, marks = scratch_path(spark, "live"), scratch_path(spark, "marks")
    windows = attack_windows(flight(spark, d))
    live.stream_capture(sdf, windows, out, marks, by=["run_id"], bucket_s=86400.0).awaitTermination()
    return spark.read.parquet(out).select(F.col("drone_id").cast("long").alias("drone_id"), "seq", "attack_type", "timestamp")


_LATEST = "(ARRAY_AGG({0} ORDER BY timestamp DESC, seq DESC) FILTER (WHERE {0} IS NOT NULL))[1]"


@query("ST2 W15 W16", f"""
SELECT sysid, COUNT(*) AS packets_received, ROUND({_LATEST.format("degrees(roll)")}, 6) AS roll_deg, {_LATEST.format("groundspeed")} AS groundspeed_mps,
  COALESCE({_LATEST.format("heading")}, ROUND((ARRAY_AGG(yaw_deg ORDER BY timestamp, seq) FILTER (WHERE yaw_deg IS NOT NULL))[1], 6)) AS heading_deg,
  {_LATEST.format("fix_type")} AS gps_fix_type
FROM (SELECT *, ((degrees(yaw) % 360) + 360) % 360 AS yaw_deg FROM flight) f GROUP BY sysid""")
def stream_gauges(spark, d):
    g = _updated(live.gauges_stream(flight_stream(spark, d)), ["sysid"])
    return g.select("sysid", "packets_received", r6("roll_deg").alias("roll_deg"), "groundspeed_mps", r6("heading_deg").alias("heading_deg"), "gps_fix_type")


@query("ST3", """
SELECT sysid, slot * 3600000 + 3600000 AS emit_ms, seq, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sysid, slot ORDER BY timestamp DESC, seq DESC) AS i FROM (SELECT *, timestamp // 3600000 AS slot FROM flight) a
) b WHERE i = 1""")
def stream_throttle(spark, d):
    sdf = flight_stream(spark, d).select("sysid", "ts", "seq", "value")
    out = _updated(live.throttle(sdf, "1 hour"), ["emit_at", "sysid"])
    return out.select("sysid", F.unix_millis("emit_at").alias("emit_ms"), "seq", "value")


@query("ST3", """
SELECT sysid, ARG_MAX(seq, timestamp * 1000000 + seq) AS seq, TRUE AS repeated, TRUE AS within_rate FROM flight GROUP BY sysid""")
def stream_ticking(spark, d):
    # All messages come in the first batch; what follows are emissions of silent systems, driven by their timers.
    sdf = flight_stream(spark, d).select("sysid", "ts", "seq")
    period, out, marks = 500, scratch_path(spark, "sink"), scratch_path(spark, "marks")
    ticks = live.ticking(sdf, period, order=["ts", "seq"])
    run = (ticks.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
           .outputMode("append").trigger(processingTime="1 second").start())
    try:
        while run.isActive and (run.lastProgress is None or run.lastProgress["batchId"] < 3):
            time.sleep(0.2)
    finally:
        run.stop()
    got = spark.read.schema(ticks.schema).parquet(out)
    by_time = Window.partitionBy("sysid").orderBy("emitted_ms")
    got = got.withColumn("gap", F.col("emitted_ms") - F.lag("emitted_ms").over(by_time))
    return got.groupBy("sysid").agg(
        F.max_by("seq", "emitted_ms").alias("seq"), (F.count(F.lit(1)) > 1).alias("repeated"),
        F.coalesce(F.min("gap") >= period, F.lit(False)).alias("within_rate"))


@query("ST4", """
WITH told AS (SELECT *, LAST_VALUE(CASE WHEN mav_packet_type = 'HEARTBEAT' THEN type END IGNORE NULLS) OVER (
    PARTITION BY run_id, sysid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t FROM flight),
lock AS (SELECT run_id, ARG_MIN(sysid, seq) AS locked, MIN(seq) AS ls FROM flight WHERE mav_packet_type = 'HEARTBEAT' AND type = 2 GROUP BY run_id)
SELECT run_id, seq FROM told t LEFT JOIN lock l USING (run_id)
WHERE NOT COALESCE(t.t <> 2, FALSE) AND NOT COALESCE(t.seq >= l.ls AND t.sysid <> l.locked, FALSE)""")
def stream_vehicle_lock(spark, d):
    sdf = flight_stream(spark, d).select("run_id", "seq", "sysid", "mav_packet_type", "type")
    return _appended(live.lock_stream(sdf, link="run_id")).select("run_id", "seq")


@query("ST5 W19", POSES_ORACLE, recursive=True)
def stream_dead_band(spark, d):
    return _appended(live.dead_band_stream(poses(flight_stream(spark, d)))).select("name", "seq")


@query("ST6", """
SELECT run_id, drone_id, window_index, row_start_index, row_end_index, window_start_timestamp, window_end_timestamp, y_true FROM pred""", pred=True)
def stream_windows(spark, d):
    rows = training_rows(S.primary(flight_stream(spark, d), "ATTITUDE"), "all")
    rows = rows.select("run_id", "drone_id", "timestamp", "seq", "y_true", "roll", "pitch")
    win = live.window_stream(rows, ["roll", "pitch"], WINDOW, STEP)
    return _appended(win).drop("tensor")


@query("ST7", "SELECT DISTINCT k AS id FROM flight")
def stream_distinct_logs(spark, d):
    sdf = flight_stream(spark, d).select(F.col("k").alias("id"), "ts", "value")
    return _appended(live.dedup_logs(sdf, "40 days")).select("id")


@query("ST8", """
SELECT sysid, COALESCE((ARRAY_AGG(type ORDER BY timestamp) FILTER (WHERE type = 2))[1], (ARRAY_AGG(type ORDER BY timestamp) FILTER (WHERE type <> 6))[1]) AS vehicle_type
FROM flight WHERE mav_packet_type = 'HEARTBEAT' AND type <> 6 GROUP BY sysid""")
def stream_vehicle_identity(spark, d):
    return _updated(live.vehicle_identity_stream(flight_stream(spark, d), ["sysid"]), ["sysid"])


@query("ST9", """
SELECT slot * 86400000 AS start_ms, mav_packet_type, COUNT(*) AS messages FROM (SELECT *, timestamp // 86400000 AS slot FROM flight) a
GROUP BY slot, mav_packet_type""")
def stream_rate_board(spark, d):
    board = _updated(live.rate_board(flight_stream(spark, d), "1 day", "1 hour"), ["start", "end", "mav_packet_type"])
    return board.select(F.unix_millis("start").alias("start_ms"), "mav_packet_type", "messages")
