"""Reports, label coverage, discovery and traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.operators import labeling, reports, state, traffic
from skytrace.functions import scalars as S
from skytrace.plans.registry import query, r6, rounded
from skytrace.session import scratch_path
from skytrace.plans.views import bronze, flight, runs
from skytrace.sources import capture


@query("A1", "SELECT COUNT(*) AS rows, COUNT(DISTINCT drone_id) AS drones FROM flight")
def report_volume(spark, d):
    return reports.volume(flight(spark, d))


@query("A2", """
SELECT MIN(c) AS min_rows, ROUND(AVG(c), 0) AS mean_rows, MAX(c) AS max_rows
FROM (SELECT drone_id, COUNT(*) AS c FROM flight GROUP BY drone_id) x""")
def report_drone_stats(spark, d):
    return reports.drone_stats(flight(spark, d))


@query("A3", "SELECT attack_type, COUNT(*) AS rows FROM flight GROUP BY attack_type ORDER BY rows DESC")
def report_label_histogram(spark, d):
    return reports.label_histogram(flight(spark, d))


@query("A4 K2", """
SELECT mav_packet_type, COUNT(*) AS total,
  CAST(COUNT(*) / NULLIF(COUNT(DISTINCT drone_id), 0) AS INTEGER) AS per_drone
FROM flight WHERE mav_packet_type IS NOT NULL
GROUP BY mav_packet_type ORDER BY total DESC, mav_packet_type LIMIT 12""")
def report_top_types(spark, d):
    return reports.top_types(flight(spark, d))


@query("A5 P5", """
SELECT attack_type, COUNT(*) AS rows,
  ROUND(CAST(MAX(TRY_CAST(groundspeed AS FLOAT)) AS DOUBLE), 2) AS max_spd_ms,
  ROUND(AVG(TRY_CAST(groundspeed AS FLOAT)), 2) AS mean_spd_ms,
  ROUND(CAST(MAX(TRY_CAST(alt AS FLOAT)) AS DOUBLE), 1) AS max_alt_m
FROM flight WHERE mav_packet_type = 'VFR_HUD' GROUP BY attack_type""")
def report_hud_dynamics(spark, d):
    return reports.hud_dynamics(bronze(spark, d))


@query("A6 P5", """
SELECT attack_type, COUNT(*) AS rows,
  ROUND(CAST(MAX(ABS(TRY_CAST(roll AS FLOAT))) AS DOUBLE) * 57.296, 1) AS max_roll_deg,
  ROUND(CAST(MAX(ABS(TRY_CAST(pitch AS FLOAT))) AS DOUBLE) * 57.296, 1) AS max_pitch_deg
FROM flight WHERE mav_packet_type = 'ATTITUDE' GROUP BY attack_type""")
def report_attitude_dynamics(spark, d):
    return reports.attitude_dynamics(bronze(spark, d))


@query("A7", "SELECT mav_packet_type, COUNT(*) AS rows FROM flight GROUP BY mav_packet_type")
def rows_per_type(spark, d):
    return reports.type_counts(flight(spark, d))


@query("A8", """
SELECT r.run_id, r.run_label, COUNT(*) FILTER (WHERE f.attack_type <> 'null') AS labelled_rows, COUNT(*) AS rows,
  r.run_label = 'attack' AND COUNT(*) FILTER (WHERE f.attack_type <> 'null') = 0 AS alert
FROM runs r JOIN flight f ON f.run_id = r.run_id GROUP BY r.run_id, r.run_label""", runs=True)
def label_coverage(spark, d):
    f = flight(spark, d)
    return reports.label_coverage(f, runs(f))


@query("S12", """
SELECT run_label, mav_packet_type, COUNT(*) AS n, MIN(timestamp) AS first_ms, MAX(timestamp) AS last_ms
FROM flight GROUP BY run_label, mav_packet_type""")
def ad_hoc_sql(spark, d):
    return capture.sql(flight(spark, d), """
        SELECT run_label, mav_packet_type, COUNT(*) AS n, MIN(timestamp) AS first_ms, MAX(timestamp) AS last_ms
        FROM flight GROUP BY run_label, mav_packet_type""")


@query("A29", """
SELECT ip_src, ip_dst, mav_packet_type, COUNT(*) AS messages,
  COUNT(*) FILTER (WHERE mav_packet_type = 'STATUSTEXT') AS commands,
  COUNT(*) FILTER (WHERE mav_packet_type <> 'STATUSTEXT') AS telemetry
FROM flight GROUP BY ip_src, ip_dst, mav_packet_type""")
def traffic_endpoints(spark, d):
    return traffic.endpoints(flight(spark, d), F.col("mav_packet_type") == "STATUSTEXT")


@query("A30 P34", """
SELECT sysid, compid,
  CONCAT_WS(',', CASE WHEN MIN(magic) = 253 AND MAX(magic) = 254 THEN '1' WHEN MAX(magic) = 254 THEN '1' END,
                 CASE WHEN MIN(magic) = 253 THEN '2' END) AS versions,
  BOOL_OR(signature <> 'null') AS signed, COUNT(*) AS messages
FROM flight GROUP BY sysid, compid""")
def traffic_protocols(spark, d):
    return traffic.protocol_fingerprint(flight(spark, d))


@query("P35 P7", """
SELECT seq, mav_packet_type FROM flight WHERE ip_src = '10.13.8.3'
  AND mav_packet_type IN ('HEARTBEAT', 'SYS_STATUS', 'GPS_RAW_INT', 'GLOBAL_POSITION_INT', 'ATTITUDE', 'ALTITUDE',
  'BATTERY_STATUS', 'VFR_HUD', 'STATUSTEXT', 'MISSION_CURRENT', 'NAV_CONTROLLER_OUTPUT', 'RADIO_STATUS')""")
def traffic_packet_filter(spark, d):
    return S.packet_filter(S.good_data(flight(spark, d)), "10.13.8.3").select("seq", "mav_packet_type")


@query("W17", """
SELECT drone_id, mav_packet_type, timestamp, seq, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY drone_id, mav_packet_type ORDER BY timestamp DESC, seq DESC) AS i FROM flight
) x WHERE i = 1""")
def latest_message_board(spark, d):
    return state.latest_per_type(flight(spark, d), ["drone_id"], cols=["value"])


@query("ST8", """
SELECT drone_id, COALESCE(
  (ARRAY_AGG(type ORDER BY timestamp, seq) FILTER (WHERE type = 2))[1],
  (ARRAY_AGG(type ORDER BY timestamp, seq) FILTER (WHERE type <> 6))[1]) AS vehicle_type
FROM flight WHERE mav_packet_type = 'HEARTBEAT' AND type <> 6 GROUP BY drone_id""")
def vehicle_identity(spark, d):
    return state.vehicle_identity(flight(spark, d), ["drone_id"])


# Attack windows derived from the flight itself: per run two overlapping windows, the
# earlier in list order wins, targets are all drones of attack runs.
_WINDOWS_SQL = """
wins AS (
  SELECT run_id, i AS window_idx, t0 + (i * 5 + 3) * 86400.0 AS start_epoch, t0 + (i * 5 + 11) * 86400.0 AS end_epoch,
    CASE WHEN i = 0 THEN 'first' ELSE 'second' END AS label
  FROM (SELECT run_id, FLOOR(MIN(frame_timestamp)) AS t0 FROM flight GROUP BY run_id) b CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) n
)"""


def attack_windows(f):
    """Two overlapping windows per run, one row per target: the drones of attack runs."""
    starts = f.groupBy("run_id").agg(F.floor(F.min("frame_timestamp")).alias("t0"))
    targets = f.filter("run_label = 'attack'").select("run_id", "drone_id").distinct()
    base = targets.join(starts, "run_id")
    return base.withColumn("window_idx", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "run_id", "drone_id", "window_idx",
        (F.col("t0") + (F.col("window_idx") * 5 + 3) * 86400.0).alias("start_epoch"),
        (F.col("t0") + (F.col("window_idx") * 5 + 11) * 86400.0).alias("end_epoch"),
        F.when(F.col("window_idx") == 0, "first").otherwise("second").alias("attack_type"))


@query("J1", "WITH " + _WINDOWS_SQL.strip() + """
SELECT f.seq, (ARRAY_AGG(w.label ORDER BY w.window_idx) FILTER (WHERE w.label IS NOT NULL))[1] AS attack_type
FROM flight f LEFT JOIN wins w ON w.run_id = f.run_id AND f.run_label = 'attack'
  AND f.frame_timestamp >= w.start_epoch AND f.frame_timestamp <= w.end_epoch
GROUP BY f.seq""")
def label_rows(spark, d):
    f = flight(spark, d)
    windows = attack_windows(f)
    # The windows last days here, so a day is the bucket.
    return labeling.label_rows(f, windows, by=["run_id"], bucket_s=86400.0).select("seq", "attack_type")


@query("J2 P9", """
SELECT f.seq, r.run_label FROM flight f JOIN runs r ON r.run_id = f.run_id WHERE r.attack <> 'none'""", runs=True)
def rows_of_labelled_runs(spark, d):
    f = flight(spark, d)
    dim = labeling.with_run_class(runs(f).drop("run_label"))
    rows, _ = labeling.attach_runs(f.drop("run_label", "run_name"), dim.filter("run_label = 'attack'"))
    return rows.select("seq", "run_label")


@query("J2", "SELECT run_id FROM runs WHERE attack = 'none'", runs=True)
def runs_without_metadata(spark, d):
    f = flight(spark, d)
    _, dropped = labeling.attach_runs(f.select("run_id"), runs(f).filter("attack <> 'none'"))
    return dropped


@query("J3", """
SELECT run_name, attack FROM runs WHERE run_name NOT IN (SELECT run_name FROM runs WHERE attack = 'gps_spoof')""", runs=True)
def unseen_runs(spark, d):
    f = flight(spark, d)
    dim = runs(f)
    path = F.concat(F.lit("/data/all/"), "run_name")
    # The manifest of a detector trained on one attack kind.
    manifest = dim.filter("attack = 'gps_spoof'").agg(F.collect_list(path).alias("train_runs")).select(
        "train_runs", F.array().cast("array<string>").alias("val_runs"), F.lit(None).cast("array<string>").alias("test_runs"))
    return labeling.exclude_seen(dim, manifest).select("run_name", "attack")


@query("J4", "SELECT run_id, run_name FROM runs WHERE run_name IN (SELECT run_name FROM runs WHERE attack = 'gps_spoof')", runs=True)
def whitelisted_runs(spark, d):
    dim = runs(flight(spark, d))
    return labeling.whitelist(dim, dim.filter("attack = 'gps_spoof'")).select("run_id", "run_name")


@query("J8", """
SELECT f.seq, f.k AS msgid, m.name FROM flight f
LEFT JOIN (SELECT DISTINCT k AS msgid, CONCAT('MSG_', CAST(k AS VARCHAR)) AS name FROM flight WHERE k < 40) m ON m.msgid = f.k""")
def message_dictionary(spark, d):
    f = flight(spark, d)
    # The dictionary lacks the upper ids, so that unknown ids occur.
    known = f.filter("k < 40").select(F.col("k").alias("msgid"), F.format_string("MSG_%d", "k").alias("name")).distinct()
    return labeling.attach_dictionary(f.select("seq", F.col("k").alias("msgid")), known).select("seq", "msgid", "name")


@query("A31 S16", """
SELECT stage, step, COUNT(*) AS n, ROUND(AVG(elapsed), 6) AS mean_s, ROUND(MAX(elapsed), 6) AS max_s
FROM (SELECT CASE WHEN k % 2 = 0 THEN 'stage2' ELSE 'stage3' END AS stage, lower(mav_packet_type) AS step,
        CAST(printf('%.2f', value) AS DOUBLE) AS elapsed FROM flight) x
GROUP BY stage, step""")
def stage_timing(spark, d):
    from skytrace.sources import logs

    line = F.format_string("[stage%d instance=%d] step=%s elapsed=%.2fs",
                           F.when(F.col("k") % 2 == 0, 2).otherwise(3), "drone_id", F.lower("mav_packet_type"), "value")
    path = scratch_path(spark, "stages")
    flight(spark, d).select(line.alias("value")).write.text(path)
    steps = logs.parse_stage_logs(spark, path)
    return rounded(logs.stage_timing(steps), "mean_s", "max_s")
