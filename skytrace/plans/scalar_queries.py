"""Cell-level functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.functions import scalars as S
from skytrace.operators import sets, state
from skytrace.plans.registry import query, r6
from skytrace.plans.views import bronze, flight, runs, table


@query("P1", """
SELECT doc_id, md5(COALESCE(replace(replace(text, ',', ';'), chr(10), ' '), 'null')) AS cell_md5,
  COALESCE(array_to_string(string_split(replace(replace(source, ',', ';'), chr(10), ' '), '/'), ';'), 'null') AS parts
FROM documents""", raw=True)
def cell_format(spark, d):
    docs = table(spark, d, "documents").withColumn("parts", F.split("source", "/"))
    kind = docs.schema["parts"].dataType
    return docs.select("doc_id", F.md5(S.format_cell("text")).alias("cell_md5"), S.format_cell("parts", kind).alias("parts"))


@query("P2", """
SELECT DISTINCT w AS field FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) x
WHERE w NOT IN ('len', 'flags', 'options', 'id', 'seq', 'timestamp', 'signature', 'checksum')""", raw=True)
def payload_union(spark, d):
    dictionary = table(spark, d, "documents").select(F.col("doc_id").alias("msgid"), F.split("text", " ").alias("fields"))
    reserved = ["len", "flags", "options", "id", "seq", "timestamp", "signature", "checksum"]
    return S.payload_union(dictionary, reserved)


@query("P3", """
SELECT mav_packet_type, 'null' AS sim_uuid, CAST(timestamp AS VARCHAR) AS timestamp, CAST(seq AS VARCHAR) AS seq,
  'null' AS checksum, ip_src, 'null' AS tcp_text, attack_type FROM flight""")
def canonical_columns(spark, d):
    wide = S.canonical_columns(bronze(spark, d), ["roll", "pitch", "yaw"])
    return wide.select("mav_packet_type", "sim_uuid", "timestamp", "seq", "checksum", "ip_src", "tcp_text", "attack_type")


@query("P4 P5 P8", """
SELECT seq, attack_type <> 'null' AS labelled, TRY_CAST(roll AS FLOAT) IS NOT NULL AS has_roll,
  TRY_CAST(k AS INTEGER) AS k, CAST(TRUNC(frame_timestamp * 1000) AS BIGINT) AS ms FROM flight""")
def cell_predicates(spark, d):
    return bronze(spark, d).select(
        F.col("seq").cast("long"), S.is_labelled("attack_type").alias("labelled"),
        S.num("roll", "float").isNotNull().alias("has_roll"), S.num("k", "int").alias("k"),
        S.to_millis(F.col("frame_timestamp").cast("double")).alias("ms"))


@query("P6 P7", """
SELECT COALESCE(roll, 0) AS roll, COALESCE(pitch, 0) AS pitch, COALESCE(yaw, 0) AS yaw, value
FROM flight WHERE mav_packet_type = 'ATTITUDE'""")
def numeric_features(spark, d):
    f = S.primary(flight(spark, d), "ATTITUDE")
    return S.numeric_only(f.drop("run_id", "drone_id", "k", "ip_src")).select("roll", "pitch", "yaw", "value")


@query("P9 P10", """
SELECT run_name, CASE WHEN lower(attack) = 'none' THEN 'benign' ELSE 'attack' END AS run_class,
  array_to_string(string_split(run_name, '_')[4:], '_') AS shape,
  regexp_extract(run_name, '(n[0-9]+_s[0-9]+_e[0-9]+)$', 1) AS strict_shape FROM runs""", runs=True)
def run_names(spark, d):
    return runs(flight(spark, d)).select(
        "run_name", S.run_class("attack").alias("run_class"), S.run_shape("run_name").alias("shape"),
        S.run_shape("run_name", strict=True).alias("strict_shape"))


@query("P11 P12", """
SELECT kind, source,
  CASE kind WHEN 'gps-spoof' THEN 'gps_spoof' WHEN 'criticalerror-spoof' THEN 'critical_error_spoof'
    ELSE replace(lower(kind), '-', '_') END AS attack_type,
  TRY_CAST(regexp_extract(source, '-([0-9]+)$', 1) AS INTEGER) AS number, replace(lower(kind), '-', '') AS slug,
  CONCAT('run_legacy-', replace(lower(kind), '-', ''), '-', CAST(COALESCE(TRY_CAST(regexp_extract(source, '-([0-9]+)$', 1) AS INTEGER), 0) AS VARCHAR), '_',
    CASE kind WHEN 'gps-spoof' THEN 'gps_spoof' WHEN 'criticalerror-spoof' THEN 'critical_error_spoof'
      ELSE replace(lower(kind), '-', '_') END, '_legacy') AS dst
FROM (SELECT DISTINCT CASE k % 3 WHEN 0 THEN 'gps-spoof' WHEN 1 THEN 'criticalerror-spoof' ELSE 'New-Kind' END AS kind,
        CONCAT('Run-', CAST(drone_id AS VARCHAR)) AS source FROM flight) x""")
def legacy_names(spark, d):
    kind = F.when(F.col("k") % 3 == 0, "gps-spoof").when(F.col("k") % 3 == 1, "criticalerror-spoof").otherwise("New-Kind")
    names = flight(spark, d).select(kind.alias("kind"), F.format_string("Run-%d", "drone_id").alias("source")).distinct()
    cls = F.lit("attack")
    return names.select(
        "kind", "source", S.attack_type_of("kind").alias("attack_type"), S.run_number("source").alias("number"),
        S.dst_slug(cls, "kind").alias("slug"), S.dst_run_name(cls, "kind", "source").alias("dst"))


@query("P16", """
SELECT DISTINCT drone_id, '4' AS ip_version, '6' AS ip_proto, CONCAT('10.13.', CAST(drone_id AS VARCHAR), '.3') AS ip_src,
  CONCAT('10.13.', CAST(drone_id AS VARCHAR), '.1') AS ip_dst, 'null' AS ip_ttl FROM flight""")
def address_fields(spark, d):
    drones = flight(spark, d).select("drone_id").distinct()
    shown = ("ip_version", "ip_proto", "ip_src", "ip_dst", "ip_ttl")
    return drones.withColumns(S.address_fields("drone_id")).select("drone_id", *shown)


@query("P18 P22 P30", """
SELECT seq, ROUND(((degrees(rollspeed / 10) % 360) + 360) % 360, 6) AS heading,
  LEAST(GREATEST(pitch - 40, -30.0), 30.0) AS pitch_bound,
  ROUND(SQRT(roll * roll + pitch * pitch + yaw * yaw), 6) AS magnitude
FROM flight WHERE mav_packet_type = 'ATTITUDE'""")
def attitude_angles(spark, d):
    f = S.primary(flight(spark, d), "ATTITUDE")
    return f.select(
        "seq", r6(S.heading_deg(F.col("rollspeed") / 10)).alias("heading"),
        S.clamp(F.col("pitch") - 40, -30, 30).alias("pitch_bound"), r6(S.magnitude("roll", "pitch", "yaw")).alias("magnitude"))


@query("P19 P20", """
SELECT seq, ROUND(lat / 1e7, 9) AS lat, ROUND(alt / 1000.0, 6) AS alt_amsl_m,
  CASE WHEN k - 50 >= 0 THEN (k - 50) / 1000.0 END AS batt_voltage_v,
  CASE WHEN k - 51 <> -1 THEN (k - 51) / 100.0 END AS batt_current_a,
  CASE WHEN k * 5 <> 255 THEN k * 5 END AS battery_remaining
FROM flight WHERE mav_packet_type = 'GPS_RAW_INT'""")
def unit_scaling(spark, d):
    f = S.primary(flight(spark, d), "GPS_RAW_INT").withColumns({
        "voltage_battery": F.col("k") - 50, "current_battery": F.col("k") - 51, "battery_remaining": F.col("k") * 5})
    out = S.scale_units(S.drop_sentinels(f))
    return out.select("seq", F.round("lat", 9).alias("lat"), r6("alt_amsl_m").alias("alt_amsl_m"),
                      "batt_voltage_v", "batt_current_a", "battery_remaining")


@query("P21 P25", """
SELECT seq, CASE WHEN ok THEN la END AS lat, CASE WHEN ok THEN lo END AS lon, fix_type >= 3 AS fixed FROM (
  SELECT seq, fix_type, la, lo, NOT (ABS(la) < 1e-9 AND ABS(lo) < 1e-9) AND la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AND fix_type >= 2 AS ok
  FROM (SELECT seq, fix_type, CAST(k * 2 - 60 AS DOUBLE) AS la, CAST(k * 5 - 150 AS DOUBLE) AS lo FROM flight WHERE mav_packet_type = 'GPS_RAW_INT') a) b""")
def position_check(spark, d):
    f = S.primary(flight(spark, d), "GPS_RAW_INT").withColumns({
        "lat": (F.col("k") * 2 - 60).cast("double"), "lon": (F.col("k") * 5 - 150).cast("double"), "gps_fix_type": F.col("fix_type")})
    return S.sanitize_position(f).select("seq", "lat", "lon", S.has_fix("fix_type").alias("fixed"))


@query("P23 P24", """
SELECT seq, CONCAT(CAST((w >> 8) & 255 AS VARCHAR), '.', CAST((w >> 16) & 255 AS VARCHAR), '.', CAST((w >> 24) & 255 AS VARCHAR)) AS firmware,
  (base_mode & 128) <> 0 AS armed
FROM (SELECT seq, base_mode, seq * 7919 % 4294967296 AS w FROM flight WHERE mav_packet_type = 'HEARTBEAT') x""")
def firmware_and_arming(spark, d):
    f = S.primary(flight(spark, d), "HEARTBEAT").withColumn("w", F.col("seq") * 7919 % F.lit(4294967296))
    return f.select("seq", S.firmware_version("w").alias("firmware"), S.is_armed("base_mode").alias("armed"))


@query("P28 K9", """
SELECT id, printf('%08d.BIN', id) AS filename, size, time_utc FROM (
  SELECT k AS id, CAST(value * 100 AS BIGINT) AS size, timestamp // 1000 AS time_utc, ROW_NUMBER() OVER (PARTITION BY k ORDER BY seq) AS i FROM flight
) x WHERE i = 1""")
def archived_logs(spark, d):
    entries = flight(spark, d).select(
        F.col("k").alias("id"), F.round(F.col("value") * 100).cast("long").alias("size"),
        F.floor(F.col("timestamp") / 1000).cast("long").alias("time_utc"), "seq")
    return state.log_entries(entries)


@query("P29", """
SELECT drone_id, COUNT(*) AS n_rows, CASE WHEN COUNT(*) >= 8 THEN (COUNT(*) - 8) // 2 + 1 ELSE 0 END AS windows
FROM flight GROUP BY drone_id""")
def window_counts(spark, d):
    per_drone = flight(spark, d).groupBy("drone_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return per_drone.withColumn("windows", S.n_windows("n_rows", 8, 2))


@query("P32 P33 U5", """
SELECT seq, 0.0::DOUBLE AS absent, COALESCE(pitch, 0) AS pitch, COALESCE(roll, 0) AS roll FROM flight""")
def feature_alignment(spark, d):
    f = flight(spark, d).select("seq", "roll", "pitch", "value")
    names = S.feature_union([f.drop("value")], keep=["seq"])
    S.validate_features(f.select("seq", *names), ["roll", "pitch"], keep=["seq"])
    return S.align(f, ["absent", *names], keep=["seq"])


# --- set operations -------------------------------------------------------
@query("U1", "SELECT drone_id FROM flight EXCEPT SELECT drone_id FROM flight WHERE mav_packet_type = 'HEARTBEAT' AND type = 2")
def skipped_drones(spark, d):
    f = flight(spark, d)
    ready = f.filter((F.col("mav_packet_type") == "HEARTBEAT") & (F.col("type") == 2)).select("drone_id")
    return sets.skipped(f.select("drone_id"), ready)


@query("U2", "SELECT drone_id FROM flight WHERE value > 300 INTERSECT SELECT drone_id FROM flight WHERE type = 2")
def effective_targets(spark, d):
    f = flight(spark, d)
    return sets.effective_targets(f.filter("type = 2").select("drone_id"), f.filter("value > 300").select("drone_id"))


@query("U6", """
SELECT seq, value, roll FROM flight WHERE run_label = 'benign' UNION ALL SELECT seq, value, NULL FROM flight WHERE run_label = 'attack'""")
def concatenated_runs(spark, d):
    f = flight(spark, d)
    return sets.concat_runs([f.filter("run_label = 'benign'").select("seq", "value", "roll"),
                             f.filter("run_label = 'attack'").select("seq", "value")])
