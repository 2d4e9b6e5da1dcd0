"""Rolling features, tensors, flat lines and as-of state."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace import fixed_values as fixed
from skytrace.functions import rolling as R
from skytrace.functions import scalars as S
from skytrace.operators import features, state, windows
from skytrace.operators.ordered import own_rows, piece_window, spread, time_bucket
from skytrace.plans.registry import query, r6, rounded
from skytrace.plans.views import STEP, WINDOW, flight

KEYS, ORDER = features.KEYS, features.ORDER


def _series(spark, d):
    """ATTITUDE rows cut into pieces, and the window over one series."""
    rows = S.primary(flight(spark, d), "ATTITUDE").select(*KEYS, *ORDER, "roll", "pitch")
    return spread(rows, KEYS, time_bucket("timestamp", features.MINUTE_MS), halo=features.HALO), piece_window(KEYS, ORDER)


def _featured(spark, d, **exprs):
    rows, w = _series(spark, d)
    out = own_rows(rows.withColumns({n: f(w) for n, f in exprs.items()}))
    return out.select("seq", *[r6(n).alias(n) for n in exprs])


_BASE = """
b AS (SELECT seq, roll, pitch, run_id, drone_id, timestamp, ROW_NUMBER() OVER w AS rn, LAG(roll) OVER w AS prev, LAG(roll, 2) OVER w AS prev2
  FROM flight WHERE mav_packet_type = 'ATTITUDE' WINDOW w AS (PARTITION BY run_id, drone_id ORDER BY timestamp, seq))"""


def _frame(n: int) -> str:
    return f"(PARTITION BY run_id, drone_id ORDER BY timestamp, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("W1", "WITH " + _BASE.strip() + """
SELECT seq, ROUND(COALESCE(roll - prev, 0), 6) AS d1,
  ROUND(CASE WHEN prev IS NULL THEN 0 ELSE (roll - prev) - COALESCE(prev - prev2, 0) END, 6) AS d2 FROM b""")
def differences(spark, d):
    return _featured(spark, d, d1=lambda w: R.diff("roll", w), d2=lambda w: R.diff("roll", w, 2))


@query("W2", "WITH " + _BASE.strip() + f"""
SELECT seq, ROUND(AVG(roll) OVER {_frame(5)}, 6) AS mean_5, ROUND(COALESCE(STDDEV_SAMP(roll) OVER {_frame(10)}, 0), 6) AS std_10,
  ROUND(MAX(roll) OVER {_frame(20)} - MIN(roll) OVER {_frame(20)}, 6) AS range_20 FROM b""")
def rolling_short(spark, d):
    return _featured(spark, d, mean_5=lambda w: R.rolling("roll", w, 5, "mean"), std_10=lambda w: R.rolling("roll", w, 10, "std"),
                     range_20=lambda w: R.rolling("roll", w, 20, "range"))


@query("W3", "WITH " + _BASE.strip() + f"""
SELECT seq, ROUND(CASE WHEN rn >= 5 THEN STDDEV_SAMP(roll) OVER {_frame(10)} ELSE 0 END, 6) AS std_10,
  ROUND(CASE WHEN rn >= 10 THEN MAX(roll) OVER {_frame(20)} - MIN(roll) OVER {_frame(20)} ELSE 0 END, 6) AS range_20 FROM b""")
def rolling_long(spark, d):
    # Half windows of 5 and 10 rows: at this scale factor series are too short for 25.
    return _featured(spark, d, std_10=lambda w: R.rolling("roll", w, 10, "std", 5), range_20=lambda w: R.rolling("roll", w, 20, "range", 10))


def _moments(w: int) -> str:
    return f"""
l AS (SELECT seq, LIST(roll) OVER {_frame(w)} AS x FROM b),
m AS (SELECT *, len(x)::DOUBLE AS n, list_avg(x) AS mu, list_min(x) = list_max(x) AS flat FROM l),
p AS (SELECT *, list_sum([(v - mu) ** 2 for v in x]) AS m2, list_sum([(v - mu) ** 3 for v in x]) AS m3,
  list_sum([(v - mu) ** 4 for v in x]) AS m4 FROM m)"""


@query("W4", "WITH " + _BASE.strip() + "," + _moments(20) + """
SELECT seq, ROUND(CASE WHEN n >= 10 AND NOT flat AND m2 / n > 1e-14 THEN SQRT(n) * m3 / m2 ** 1.5 * SQRT(n * (n - 1)) / (n - 2) ELSE 0 END, 6) AS skew_20 FROM p""")
def rolling_skewness(spark, d):
    return _featured(spark, d, skew_20=lambda w: R.rolling_skew("roll", w, 20))


@query("W5", "WITH " + _BASE.strip() + "," + _moments(20) + """
SELECT seq, ROUND(CASE WHEN n < 10 THEN 0 WHEN flat THEN -3 WHEN m2 / n > 1e-14
  THEN (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / m2 ** 2 - 3) + 6) ELSE 0 END, 6) AS kurt_20 FROM p""")
def rolling_kurtosis(spark, d):
    return _featured(spark, d, kurt_20=lambda w: R.rolling_kurt("roll", w, 20))


@query("W6", "WITH " + _BASE.strip() + f""",
s AS (SELECT *, AVG(roll) OVER {_frame(10)} AS mx, AVG(prev) OVER {_frame(10)} AS my, STDDEV_SAMP(roll) OVER {_frame(10)} AS sx,
  STDDEV_SAMP(prev) OVER {_frame(10)} AS sy FROM b),
t AS (SELECT *, CASE WHEN rn >= 6 THEN (roll - mx) * (prev - my) END AS p FROM s),
u AS (SELECT *, AVG(p) OVER {_frame(10)} AS num, COUNT(p) OVER {_frame(10)} AS np FROM t)
SELECT seq, ROUND(CASE WHEN np >= 5 THEN num / (CASE WHEN sx = 0 THEN 1e-9 ELSE sx END * CASE WHEN sy = 0 THEN 1e-9 ELSE sy END) ELSE 0 END, 6) AS autocorr_10 FROM u""")
def rolling_autocorrelation(spark, d):
    rows, w = _series(spark, d)
    out = own_rows(R.rolling_autocorr(rows, "roll", w, 10))
    return out.select("seq", r6("roll_autocorr_10").alias("autocorr_10"))


@query("W7", "WITH " + _BASE.strip() + f"""
SELECT seq, ROUND(COALESCE((roll - AVG(roll) OVER {_frame(20)}) / (CASE WHEN STDDEV_SAMP(roll) OVER {_frame(20)} = 0 THEN 1e-9
  ELSE STDDEV_SAMP(roll) OVER {_frame(20)} END), 0), 6) AS z FROM b""")
def rolling_zscore(spark, d):
    return _featured(spark, d, z=lambda w: R.zscore("roll", w))


# --- the whole feature set ----------------------------------------------------------
def _feature_sql(kind: str) -> str:
    """Every feature of a type written out: lists of each frame, central sums, nested products."""
    core = fixed.CORE_FEATURES[kind]
    sizes = (5, 10, 20, 50)
    part = "PARTITION BY run_id, drone_id ORDER BY timestamp, seq"
    mags = ""
    if kind == "ATTITUDE":
        core_x = core + ["rate_mag"]
        mags = ", SQRT(rollspeed ** 2 + pitchspeed ** 2 + yawspeed ** 2) AS rate_mag, SQRT(roll ** 2 + pitch ** 2 + yaw ** 2) AS attitude_mag"
    else:
        core_x = core
    base = f"b AS (SELECT *{mags}, ROW_NUMBER() OVER ({part}) AS rn FROM flight WHERE mav_packet_type = '{kind}')"
    lists = ", ".join(
        [f"LIST({c}) OVER ({part} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_l{w}" for c in core_x for w in sizes]
        + [f"LAG({c}) OVER ({part}) AS {c}_p, LAG({c}, 2) OVER ({part}) AS {c}_pp" for c in core])
    cols = ", ".join(core_x + (["attitude_mag"] if mags else []))
    l1 = f"l AS (SELECT run_id, drone_id, timestamp, seq, rn, {cols}, {lists} FROM b)"
    flat = lambda c, w: f"list_min({c}_l{w}) = list_max({c}_l{w})"
    mean = lambda c, w: f"CASE WHEN {flat(c, w)} THEN {c} ELSE list_avg({c}_l{w}) END AS {c}_m{w}"
    l2 = "m AS (SELECT *, " + ", ".join(mean(c, w) for c in core_x for w in sizes) + " FROM l)"
    power = lambda c, w, p: f"list_sum([(v - {c}_m{w}) ** {p} for v in {c}_l{w}]) AS {c}_q{p}_{w}"
    l3 = "q AS (SELECT *, " + ", ".join(power(c, w, p) for c in core_x for w in sizes for p in (2, 3, 4) if p == 2 or w >= 20) + " FROM m)"
    std = lambda c, w, least: f"CASE WHEN LEAST(rn, {w}) >= {max(least, 2)} THEN SQRT({c}_q2_{w} / (LEAST(rn, {w}) - 1)) ELSE 0 END"
    floor = lambda e: f"(CASE WHEN ({e}) = 0 THEN 1e-9 ELSE ({e}) END)"
    deep = [c for c in core if c not in fixed.SHORT_WINDOW_ONLY]
    l4 = "s AS (SELECT *, " + ", ".join(f"{std(c, w, w // 2)} AS {c}_sd{w}" for c in deep for w in (20, 50)) + " FROM q)"
    l5 = "t AS (SELECT *, " + ", ".join(
        f"CASE WHEN rn > {w // 2} THEN ({c} - {c}_m{w}) * ({c}_p - LAG({c}_m{w}) OVER ({part})) END AS {c}_pr{w}, LAG({c}_sd{w}) OVER ({part}) AS {c}_sp{w}"
        for c in deep for w in (20, 50)) + " FROM s)"
    frame = lambda w: f"({part} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    l6 = "u AS (SELECT *, " + ", ".join(
        f"LIST({c}_pr{w}) FILTER (WHERE {c}_pr{w} IS NOT NULL) OVER {frame(w)} AS {c}_pl{w}" for c in deep for w in (20, 50)) + " FROM t)"
    out = {}
    for c in core:
        out[c] = c
        out[f"{c}_d1"] = f"COALESCE({c} - {c}_p, 0)"
        out[f"{c}_d2"] = f"CASE WHEN {c}_p IS NULL THEN 0 ELSE ({c} - {c}_p) - COALESCE({c}_p - {c}_pp, 0) END"
        for w in (5, 10, 20):
            out[f"{c}_mean_{w}"] = f"{c}_m{w}"
            out[f"{c}_std_{w}"] = std(c, w, 1)
            out[f"{c}_range_{w}"] = f"list_max({c}_l{w}) - list_min({c}_l{w})"
        out[f"{c}_zscore"] = f"CASE WHEN rn > 1 THEN ({c} - {c}_m20) / {floor(std(c, 20, 1))} ELSE 0 END"
        if c not in deep:
            continue
        for w in (20, 50):
            n = f"LEAST(rn, {w})::DOUBLE"
            q2, q3, q4 = (f"{c}_q{p}_{w}" for p in (2, 3, 4))
            kurt = f"({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * ({n} * {q4} / {q2} ** 2 - 3) + 6)"
            out[f"{c}_kurt_{w}"] = f"CASE WHEN rn < {w // 2} THEN 0 WHEN {flat(c, w)} THEN -3 WHEN {q2} / {n} > 1e-14 THEN {kurt} ELSE 0 END"
            if kind in fixed.SKEW_TYPES:
                skew = f"SQRT({n}) * {q3} / {q2} ** 1.5 * SQRT({n} * ({n} - 1)) / ({n} - 2)"
                out[f"{c}_skew_{w}"] = f"CASE WHEN rn >= {w // 2} AND NOT ({flat(c, w)}) AND {q2} / {n} > 1e-14 THEN {skew} ELSE 0 END"
            out[f"{c}_autocorr_{w}"] = f"CASE WHEN COALESCE(len({c}_pl{w}), 0) >= {w // 2} THEN list_avg({c}_pl{w}) / ({floor(f'{c}_sd{w}')} * {floor(f'{c}_sp{w}')}) ELSE 0 END"
        out[f"{c}_std_50"] = std(c, 50, 25)
        out[f"{c}_range_50"] = f"CASE WHEN rn >= 25 THEN list_max({c}_l50) - list_min({c}_l50) ELSE 0 END"
    if mags:
        out |= {"rate_mag": "rate_mag", "attitude_mag": "attitude_mag", "rate_mag_std_20": std("rate_mag", 20, 10)}
    body = ", ".join(f"ROUND({e}, 6) AS {n}" for n, e in out.items())
    return "WITH " + ",\n".join([base, l1, l2, l3, l4, l5, l6]) + f"\nSELECT seq, {body} FROM u"


def _engineered(f, kind):
    out = features.engineer(f, kind)
    names = features.feature_names(kind)
    # Negative zero prints like zero but is another value; adding zero evens it out.
    return out.selectExpr("seq", *[f"round({n}, 6) + 0.0D AS {n}" for n in names])


@query("W20 W1 W2 W3 W4 W5 W6 W7 P30", _feature_sql("ATTITUDE"))
def features_attitude(spark, d):
    return _engineered(flight(spark, d), "ATTITUDE")


@query("W20", _feature_sql("GPS_RAW_INT"))
def features_gps(spark, d):
    return _engineered(flight(spark, d), "GPS_RAW_INT")


@query("W20", _feature_sql("VFR_HUD"))
def features_hud(spark, d):
    return _engineered(flight(spark, d), "VFR_HUD")


@query("W20", _feature_sql("VFR_HUD").replace("FROM flight WHERE", "FROM (SELECT * REPLACE (CASE WHEN drone_id % 3 > 0 THEN drone_id END AS drone_id) FROM flight) f WHERE"))
def features_of_unknown_drones(spark, d):
    f = flight(spark, d)
    return _engineered(f.withColumn("drone_id", F.when(F.col("drone_id") % 3 > 0, F.col("drone_id"))), "VFR_HUD")


# --- windows ------------------------------------------------------------------------
@query("W9 H8", """
SELECT p.run_id, p.drone_id, p.window_index, CAST(f.rn - p.row_start_index - 1 AS INTEGER) AS step, CAST(f.roll AS FLOAT)::DOUBLE AS roll, CAST(f.pitch AS FLOAT)::DOUBLE AS pitch
FROM pred p JOIN (SELECT run_id, drone_id, roll, pitch, ROW_NUMBER() OVER (PARTITION BY run_id, drone_id ORDER BY timestamp, seq) AS rn
  FROM flight WHERE mav_packet_type = 'ATTITUDE') f
ON f.run_id = p.run_id AND f.drone_id = p.drone_id AND f.rn > p.row_start_index AND f.rn <= p.row_end_index""", pred=True)
def window_tensors(spark, d):
    rows = S.primary(flight(spark, d), "ATTITUDE").select(*KEYS, *ORDER, "roll", "pitch")
    steps = windows.tensor_steps(windows.window_tensors(rows, ["roll", "pitch"], WINDOW, STEP))
    value = lambda i: F.col("features")[i].cast("double")
    return steps.select(*KEYS, "window_index", "step", value(0).alias("roll"), value(1).alias("pitch"))


@query("W18", """
SELECT run_id, drone_id, CAST((rn - 4) / 2 AS BIGINT) AS window_index, a < 60 AND b < 3 AS frozen FROM (
  SELECT run_id, drone_id, ROW_NUMBER() OVER o AS rn, MAX(pitch) OVER w - MIN(pitch) OVER w AS a, MAX(yawspeed) OVER w - MIN(yawspeed) OVER w AS b
  FROM flight WHERE mav_packet_type = 'ATTITUDE'
  WINDOW o AS (PARTITION BY run_id, drone_id ORDER BY timestamp, seq),
    w AS (PARTITION BY run_id, drone_id ORDER BY timestamp, seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
) x WHERE rn >= 4 AND (rn - 4) % 2 = 0""")
def flat_line_windows(spark, d):
    rows = S.primary(flight(spark, d), "ATTITUDE").select(*KEYS, *ORDER, "pitch", (F.col("yawspeed") * 20).alias("yawspeed"))
    # One threshold for all columns: yaw speed is stretched so that 3 units reach it.
    return windows.flat_line(rows, ["pitch", "yawspeed"], 4, STEP, 60.0)


# --- as-of state --------------------------------------------------------------------
_LAST = "LAST_VALUE({} IGNORE NULLS) OVER w"


@query("W15 W16 ST2 P18 P22", f"""
SELECT sysid, seq, ROUND({_LAST.format("degrees(roll)")}, 6) AS roll_deg, {_LAST.format("groundspeed")} AS groundspeed_mps,
  ROUND(COALESCE({_LAST.format("heading")}, FIRST_VALUE(yaw_deg IGNORE NULLS) OVER w), 6) AS heading_deg,
  {_LAST.format("CASE WHEN throttle > 100 THEN 100.0 WHEN throttle < 0 THEN 0.0 ELSE throttle END")} AS throttle_pct, {_LAST.format("fix_type")} AS gps_fix_type,
  {_LAST.format("CASE WHEN base_mode IS NOT NULL THEN (base_mode & 128) <> 0 END")} AS armed
FROM (SELECT *, ((degrees(yaw) % 360) + 360) % 360 AS yaw_deg FROM flight) f
WINDOW w AS (PARTITION BY sysid ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)""")
def gauges_asof(spark, d):
    g = state.gauges_asof(flight(spark, d))
    return g.select("sysid", "seq", r6("roll_deg").alias("roll_deg"), "groundspeed_mps", r6("heading_deg").alias("heading_deg"),
                    "throttle_pct", "gps_fix_type", "armed")


@query("W16", f"""
SELECT sysid, timestamp, seq, ROUND(COALESCE({_LAST.format("heading")}, FIRST_VALUE(yaw_deg IGNORE NULLS) OVER w), 6) AS heading_deg
FROM (SELECT *, ((degrees(yaw) % 360) + 360) % 360 AS yaw_deg FROM flight) f
WINDOW w AS (PARTITION BY sysid ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)""")
def heading_fallback(spark, d):
    return rounded(state.heading_fallback(flight(spark, d)), "heading_deg")


@query("ST4", """
WITH told AS (SELECT *, LAST_VALUE(CASE WHEN mav_packet_type = 'HEARTBEAT' THEN type END IGNORE NULLS) OVER (
    PARTITION BY run_id, sysid ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS t FROM flight),
lock AS (SELECT run_id, sysid AS locked, timestamp AS lt, seq AS ls FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY timestamp, seq) AS i FROM flight WHERE mav_packet_type = 'HEARTBEAT' AND type = 2) x WHERE i = 1)
SELECT run_id, seq FROM told t LEFT JOIN lock l USING (run_id)
WHERE NOT COALESCE(t.t <> 2, FALSE) AND NOT COALESCE((t.timestamp, t.seq) >= (l.lt, l.ls) AND t.sysid <> l.locked, FALSE)""")
def vehicle_lock(spark, d):
    return state.lock_vehicle(flight(spark, d), by=["run_id"]).select("run_id", "seq")


POSES_SQL = """
poses AS (SELECT CONCAT('drone_', CAST(drone_id AS VARCHAR(20))) AS name, seq, FLOOR(timestamp / 86400000) * 0.02 AS time,
  k % 5 * 0.008 AS x, 0.0 AS y, 0.0 AS z, CASE WHEN seq % 7 = 0 THEN 0.8 ELSE 1.0 END AS qw, 0.0 AS qx, 0.0 AS qy,
  CASE WHEN seq % 7 = 0 THEN 0.6 ELSE 0.0 END AS qz FROM flight)"""

POSES_ORACLE = "WITH " + POSES_SQL.strip() + """,
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY seq) AS rn FROM poses),
g AS (
  SELECT name, rn, seq, time AS t, x AS px, qw AS pw, qz AS pz, FALSE AS sent FROM n WHERE rn = 1
  UNION ALL
  SELECT name, rn, seq, CASE WHEN ok THEN nt ELSE t END, CASE WHEN ok THEN nx ELSE px END, CASE WHEN ok THEN nw ELSE pw END, CASE WHEN ok THEN nz ELSE pz END, ok
  FROM (SELECT n.name, n.rn, n.seq, n.time AS nt, n.x AS nx, n.qw AS nw, n.qz AS nz, g.t, g.px, g.pw, g.pz,
      NOT (n.time - g.t > 0 AND n.time - g.t < 0.03) AND ((n.x - g.px) ** 2 > 1e-4 OR ((n.qw * g.pz - n.qz * g.pw) / (n.qw ** 2 + n.qz ** 2)) ** 2 > 1e-4) AS ok
    FROM g JOIN n ON n.name = g.name AND n.rn = g.rn + 1) s
)
SELECT name, seq FROM g WHERE sent"""


def poses(f):
    day = F.floor(F.col("timestamp") / 86400000).cast("double")
    turned = F.col("seq") % 7 == 0
    zero = F.lit(0.0)
    return f.select(
        F.concat(F.lit("drone_"), F.col("drone_id").cast("string")).alias("name"), "seq", (day * 0.02).alias("time"),
        ((F.col("k") % 5).cast("double") * 0.008).alias("x"), zero.alias("y"), zero.alias("z"),
        F.when(turned, 0.8).otherwise(1.0).alias("qw"), zero.alias("qx"), zero.alias("qy"), F.when(turned, 0.6).otherwise(0.0).alias("qz"))


@query("W19 ST5", POSES_ORACLE, recursive=True)
def pose_dead_band(spark, d):
    return state.dead_band(poses(flight(spark, d))).select("name", "seq")
