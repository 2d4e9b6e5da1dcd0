"""Telemetry views over the ``events`` table.

The texts are valid in Spark SQL and in ANSI-style engines with the same functions,
except for ``{millis}``, the epoch in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skytrace.session import use_utc

FLIGHT_SQL = """
SELECT seq, drone_id, run_id, run_label, run_attack,
  CONCAT('run_20240101T00000', CAST(run_id AS VARCHAR(20)), 'Z_', run_attack, '_n50_s60_e', CAST(1200 + 60 * (run_id % 2) AS VARCHAR(20))) AS run_name,
  mav_packet_type, timestamp, CAST(timestamp AS DOUBLE) / 1000.0 AS frame_timestamp, value, k,
  CASE WHEN run_id >= 4 AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
       THEN run_attack ELSE 'null' END AS attack_type,
  drone_id AS sysid, k % 3 AS compid,
  CASE WHEN k % 4 = 0 THEN 254 ELSE 253 END AS magic,
  CASE WHEN drone_id % 7 = 0 AND k % 5 = 0 THEN 'ab12' ELSE 'null' END AS signature,
  CONCAT('10.13.', CAST(drone_id AS VARCHAR(20)), '.3') AS ip_src,
  CONCAT('10.13.', CAST(drone_id AS VARCHAR(20)), '.', CAST(1 + k % 2 AS VARCHAR(20))) AS ip_dst,
  CASE WHEN att THEN value END AS roll,
  CASE WHEN att THEN CAST(k AS DOUBLE) END AS pitch,
  CASE WHEN att THEN CAST(seq % 97 AS DOUBLE) END AS yaw,
  CASE WHEN att THEN CAST(k - 50 AS DOUBLE) END AS rollspeed,
  CASE WHEN att THEN SQRT(CAST(seq % 13 AS DOUBLE)) END AS pitchspeed,
  CASE WHEN att THEN SQRT(CAST(k AS DOUBLE)) END AS yawspeed,
  CASE WHEN hud THEN value END AS airspeed,
  CASE WHEN hud THEN CAST(k AS DOUBLE) END AS groundspeed,
  CASE WHEN hud THEN CAST(seq % 360 AS DOUBLE) END AS heading,
  CASE WHEN hud THEN CAST(k + 20 AS DOUBLE) END AS throttle,
  CASE WHEN hud THEN CAST(k - 50 AS DOUBLE) END AS climb,
  CASE WHEN hud THEN CAST(k * 3 AS DOUBLE) WHEN gps THEN CAST(k * 100 AS DOUBLE) END AS alt,
  CASE WHEN gps THEN CAST(4700 + k AS DOUBLE) END AS lat,
  CASE WHEN gps THEN CAST(850 + seq % 89 AS DOUBLE) END AS lon,
  CASE WHEN gps THEN CAST(k * 100 + 50 AS DOUBLE) END AS alt_ellipsoid,
  CASE WHEN gps THEN CAST(seq % 359 AS DOUBLE) END AS cog,
  CASE WHEN gps THEN value END AS vel,
  CASE WHEN gps THEN CAST(k AS DOUBLE) END AS eph,
  CASE WHEN gps THEN SQRT(CAST(k AS DOUBLE)) END AS epv,
  CASE WHEN gps THEN CAST(seq % 20 AS DOUBLE) END AS satellites_visible,
  CASE WHEN gps THEN k % 6 END AS fix_type,
  CASE WHEN mav_packet_type = 'HEARTBEAT' THEN CASE WHEN drone_id % 5 = 0 THEN 6 WHEN drone_id % 5 = 1 THEN 13 ELSE 2 END END AS type,
  CASE WHEN mav_packet_type = 'HEARTBEAT' THEN k * 3 END AS base_mode
FROM (
  SELECT e.*, event_type = 'click' AS att, event_type = 'view' AS hud, event_type = 'purchase' AS gps,
    CASE WHEN run_id < 4 THEN 'benign' ELSE 'attack' END AS run_label,
    CASE WHEN run_id < 4 THEN 'none' WHEN run_id % 2 = 0 THEN 'gps_spoof' ELSE 'attitude_spoof' END AS run_attack
  FROM (
    SELECT event_id AS seq, user_id AS drone_id, user_id % 10 AS run_id, event_type, ts, value,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
      {millis} AS timestamp,
      CASE event_type WHEN 'click' THEN 'ATTITUDE' WHEN 'view' THEN 'VFR_HUD' WHEN 'purchase' THEN 'GPS_RAW_INT'
        WHEN 'signup' THEN 'HEARTBEAT' ELSE 'STATUSTEXT' END AS mav_packet_type
    FROM events
  ) e
) f
"""

RUNS_SQL = """
SELECT run_id, run_name, run_attack AS attack, run_label, COUNT(DISTINCT drone_id) AS drones
FROM flight GROUP BY run_id, run_name, run_attack, run_label
"""

# Predictions: count windows of 8 rows, 2 apart, over ATTITUDE rows with all attack
# rows kept; the last row's value gives the score.
WINDOW, STEP = 8, 2
PRED_SQL = """
SELECT run_id, drone_id, run_label, run_attack AS attack_type,
  CAST((rn - 8) / 2 AS BIGINT) AS window_index, rn - 8 AS row_start_index, rn AS row_end_index,
  begun AS window_start_timestamp, CAST(timestamp AS DOUBLE) AS window_end_timestamp, y_true,
  LEAST(value / 100.0, 1.0) AS y_prob
FROM (
  SELECT *, ROW_NUMBER() OVER w AS rn, LAG(CAST(timestamp AS DOUBLE), 7) OVER w AS begun,
    CASE WHEN run_label = 'attack' AND attack_type <> 'null' THEN 1 ELSE 0 END AS y_true
  FROM flight WHERE mav_packet_type = 'ATTITUDE'
  WINDOW w AS (PARTITION BY run_id, drone_id ORDER BY timestamp, seq)
) r WHERE rn >= 8 AND (rn - 8) % 2 = 0
"""

# Stated, so that opening the table costs no schema job.
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

DUCK_MILLIS = "epoch_us(ts) // 1000"
SPARK_MILLIS = "unix_millis(CAST(ts AS TIMESTAMP))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(EVENTS_SCHEMA) if name == "events" else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed telemetry rows derived from ``events``."""
    use_utc(spark)
    return over_events(spark, table(spark, sf_dir, "events"))


def over_events(spark: SparkSession, events: DataFrame) -> DataFrame:
    text = FLIGHT_SQL.format(millis=SPARK_MILLIS).replace("FROM events", "FROM {events}")
    return spark.sql(text, events=events)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a capture holds them: text cells, ``null`` where absent."""
    rows = flight(spark, sf_dir)
    ids = {"run_id", "drone_id", "run_name", "run_label"}
    text = "coalesce(translate(cast(`{0}` AS string), ',\\n', '; '), 'null') AS `{0}`"
    return rows.selectExpr(*[f"`{c}`" if c in ids else text.format(c) for c in rows.columns])


def runs(df: DataFrame) -> DataFrame:
    """The run dimension of a flight frame."""
    per_drone = df.select("run_id", "run_name", F.col("run_attack").alias("attack"), "run_label", "drone_id").distinct()
    return per_drone.groupBy("run_id", "run_name", "attack", "run_label").agg(F.count("drone_id").alias("drones"))


def predictions(df: DataFrame) -> DataFrame:
    """Window records of ATTITUDE rows with the stand-in score ``least(value / 100, 1)``."""
    from skytrace.functions.scalars import primary
    from skytrace.operators.windows import causal_windows, training_rows

    rows = training_rows(primary(df, "ATTITUDE"), "all").select(
        "run_id", "drone_id", "timestamp", "seq", "run_label", "run_attack", "y_true", "value"
    )
    win = causal_windows(rows, WINDOW, STEP, keep=["run_label", "run_attack", "y_true", "value"])
    return win.withColumnRenamed("run_attack", "attack_type").withColumn(
        "y_prob", F.least(F.col("value") / 100.0, F.lit(1.0))
    ).drop("value")


def stored_predictions(df: DataFrame) -> DataFrame:
    """Predictions as a stored table, which is what a detector leaves behind.

    For metrics that pass over them several times.
    """
    from skytrace.session import stored

    return stored(predictions(df), "predictions")


def oracle(body: str, *, runs_view: bool = False, pred: bool = False, recursive: bool = False) -> str:
    """An oracle query over the view ``flight`` (and ``runs``, ``pred`` when asked)."""
    parts = [f"flight AS ({FLIGHT_SQL.format(millis=DUCK_MILLIS)})"]
    if runs_view:
        parts.append(f"runs AS ({RUNS_SQL})")
    if pred:
        parts.append(f"pred AS ({PRED_SQL})")
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + body
