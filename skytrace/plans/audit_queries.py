"""Dataset audit and run splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.operators import audit, scaling, splits, windows
from skytrace.functions import scalars as S
from skytrace.plans.registry import query, r6, rounded
from skytrace.plans.views import STEP, WINDOW, flight, predictions, runs
from skytrace.sources import capture

_USABLE = """
usable AS (
  SELECT run_id, run_name, run_label, drone_id, COUNT(*) AS n_rows FROM flight
  WHERE mav_packet_type = 'ATTITUDE' AND (run_label = 'benign' OR attack_type <> 'null')
  GROUP BY run_id, run_name, run_label, drone_id
),
per_run AS (
  SELECT r.run_id, r.run_name, r.run_label, array_to_string(string_split(r.run_name, '_')[4:], '_') AS shape,
    CAST(COALESCE(SUM(n_rows), 0) AS BIGINT) AS rows,
    CAST(COALESCE(SUM(CASE WHEN n_rows >= 8 THEN (n_rows - 8) // 2 + 1 ELSE 0 END), 0) AS BIGINT) AS windows,
    COALESCE(BOOL_OR(n_rows < 8), FALSE) AND COALESCE(SUM(CASE WHEN n_rows >= 8 THEN (n_rows - 8) // 2 + 1 ELSE 0 END), 0) = 0 AS below_window
  FROM runs r LEFT JOIN usable u ON u.run_id = r.run_id GROUP BY r.run_id, r.run_name, r.run_label
)"""


def _per_run(spark, d):
    f = flight(spark, d)
    dim = runs(f)
    return audit.run_totals(audit.usable_rows(f, dim, "ATTITUDE"), dim, WINDOW, STEP)


@query("A9", "WITH " + _USABLE.strip() + " SELECT run_id, drone_id, CAST(n_rows AS BIGINT) AS n_rows FROM usable", runs=True)
def audit_usable_rows(spark, d):
    f = flight(spark, d)
    return audit.usable_rows(f, runs(f), "ATTITUDE").select("run_id", "drone_id", "n_rows")


@query("A10 P29", "WITH " + _USABLE.strip() + " SELECT * FROM per_run", runs=True)
def audit_run_totals(spark, d):
    return _per_run(spark, d)


@query("A10", "WITH " + _USABLE.strip() + """
SELECT run_name, run_label, shape, COUNT(*) AS runs, CAST(SUM(rows) AS BIGINT) AS rows, CAST(SUM(windows) AS BIGINT) AS windows
FROM per_run GROUP BY GROUPING SETS ((run_name), (run_label), (shape))""", runs=True)
def audit_totals(spark, d):
    return audit.audit_totals(_per_run(spark, d))


@query("A11", "WITH " + _USABLE.strip() + """
SELECT run_label, COUNT(*) AS runs, MIN(rows) AS min_rows, MAX(rows) AS max_rows, MIN(windows) AS min_windows, MAX(windows) AS max_windows
FROM per_run GROUP BY run_label""", runs=True)
def audit_class_extremes(spark, d):
    return audit.class_extremes(_per_run(spark, d))


@query("A12", "WITH " + _USABLE.strip() + """
SELECT shape, CASE WHEN COUNT(DISTINCT run_label) > 1 THEN 'mixed' ELSE MIN(run_label) END AS class, COUNT(*) AS runs,
  CAST(SUM(rows) AS BIGINT) AS rows, CAST(SUM(windows) AS BIGINT) AS windows FROM per_run GROUP BY shape""", runs=True)
def audit_shape_classes(spark, d):
    return audit.shape_classes(_per_run(spark, d))


@query("A28", "WITH " + _USABLE.strip() + """,
c AS (SELECT CAST(SUM(windows) FILTER (WHERE run_label = 'attack') AS BIGINT) AS a, CAST(SUM(windows) FILTER (WHERE run_label = 'benign') AS BIGINT) AS b FROM per_run),
s AS (SELECT shape, CAST(SUM(windows) AS BIGINT) AS w FROM per_run GROUP BY shape ORDER BY w DESC, shape LIMIT 1)
SELECT a AS attack_windows, b AS benign_windows, ROUND(GREATEST(a, b) / LEAST(a, b), 6) AS ratio,
  CASE WHEN w / (a + b) >= 0.7 THEN shape END AS dominant_shape, ROUND(CASE WHEN w / (a + b) >= 0.7 THEN w / (a + b) END, 6) AS dominant_share
FROM c, s""", runs=True)
def audit_balance(spark, d):
    return rounded(audit.balance(_per_run(spark, d)), "ratio", "dominant_share")


@query("D2", "WITH " + _USABLE.strip() + """,
n AS (SELECT run_label, COUNT(*) AS n FROM per_run GROUP BY run_label),
t AS (SELECT *, GREATEST(1, CAST(ROUND_EVEN(n * 0.2, 0) AS BIGINT)) AS n_test FROM n),
v AS (SELECT *, GREATEST(1, CAST(ROUND_EVEN((n - n_test) * 0.2, 0) AS BIGINT)) AS n_val FROM t)
SELECT run_label, n, n - n_test - n_val AS n_train, n_val, n_test FROM v""", runs=True)
def audit_projected_split(spark, d):
    n = _per_run(spark, d).groupBy("run_label").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumns(audit.projected_split("n"))


@query("D8", "WITH " + _USABLE.strip() + """
SELECT w AS window_size, s AS stride, run_label, CAST(SUM(n_rows) AS BIGINT) AS rows,
  CAST(SUM(CASE WHEN n_rows >= w THEN (n_rows - w) // s + 1 ELSE 0 END) AS BIGINT) AS windows
FROM usable, (VALUES (4, 1), (8, 2), (12, 2), (16, 4), (20, 4)) AS g(w, s) GROUP BY w, s, run_label""", runs=True)
def audit_what_if(spark, d):
    f = flight(spark, d)
    return audit.audit_grid(audit.usable_rows(f, runs(f), "ATTITUDE"), [(4, 1), (8, 2), (12, 2), (16, 4), (20, 4)])


@query("U3", "WITH " + _USABLE.strip() + """
SELECT run_name FROM per_run WHERE windows = 0 EXCEPT SELECT run_name FROM per_run WHERE below_window""", runs=True)
def audit_zero_window_runs(spark, d):
    from skytrace.operators.sets import zero_window_only

    per_run = _per_run(spark, d)
    return zero_window_only(per_run.filter("windows = 0").select("run_name"), per_run.filter("below_window").select("run_name"))


@query("U3", "SELECT run_name FROM runs WHERE run_label = 'attack'", runs=True)
def zero_window_runs_unexplained(spark, d):
    from skytrace.operators.sets import zero_window_only

    f = flight(spark, d)
    dim = runs(f)
    # windows longer than any capture: all runs have none, and only benign ones are known to be short
    per_run = audit.run_totals(audit.usable_rows(f, dim, "ATTITUDE"), dim, 10**9, STEP)
    short = per_run.filter("run_label = 'benign'").select("run_name")
    return zero_window_only(per_run.filter("windows = 0").select("run_name"), short)


@query("D1 K7 U3", "WITH " + _USABLE.strip() + """,
sh AS (SELECT shape, COUNT(DISTINCT run_label) AS c, MIN(run_label) AS l, CAST(SUM(windows) AS BIGINT) AS w FROM per_run GROUP BY shape),
c AS (SELECT run_label AS cls, COUNT(*) AS n, CAST(SUM(windows) AS BIGINT) AS w FROM per_run GROUP BY run_label),
ab AS (SELECT MAX(n) FILTER (WHERE cls = 'attack') AS na, MAX(n) FILTER (WHERE cls = 'benign') AS nb,
  MAX(w) FILTER (WHERE cls = 'attack') AS aw, MAX(w) FILTER (WHERE cls = 'benign') AS bw FROM c),
bal AS (SELECT *, GREATEST(aw, bw) / LEAST(aw, bw) AS r FROM ab),
short AS (SELECT COUNT(*) AS n, list(run_name ORDER BY run_name) AS names FROM per_run WHERE below_window),
other AS (SELECT COUNT(*) AS n, list(run_name ORDER BY run_name) AS names FROM per_run WHERE windows = 0 AND NOT below_window),
cls AS (SELECT v.cls, COALESCE(c.n, 0) AS n FROM (VALUES ('attack'), ('benign')) AS v(cls) LEFT JOIN c ON c.cls = v.cls)
SELECT 'WARN' AS severity, CONCAT(CAST(s.n AS VARCHAR), ' run(s) have rows < window_size', CASE WHEN o.n = 0 THEN ' (produce 0 windows)' ELSE '' END, ': ',
  array_to_string(s.names[1:5], ', '), CASE WHEN s.n > 5 THEN ' …' ELSE '' END) AS message FROM short s, other o WHERE s.n > 0
UNION ALL SELECT 'WARN', CONCAT(CAST(n AS VARCHAR), ' run(s) produce 0 windows for other reasons: ', array_to_string(names[1:5], ', '), CASE WHEN n > 5 THEN ' …' ELSE '' END) FROM other WHERE n > 0
UNION ALL SELECT 'SEVERE', CONCAT(cls, CASE WHEN n = 0 THEN ' class has 0 runs — cannot train'
  ELSE CONCAT(' class has ', CAST(n AS VARCHAR), ' run(s) — not enough for run-level train/val/test (need ≥3)') END) FROM cls WHERE n < 3
UNION ALL SELECT 'WARN', CONCAT('shape `', shape, '` exists only in ', l, ' class') FROM sh WHERE c = 1
UNION ALL SELECT 'WARN', CONCAT(cls, ' class has ', CAST(n AS VARCHAR), ' run(s) — fragile train/val/test; recommend ≥5') FROM c WHERE n >= 3 AND n < 5
UNION ALL SELECT 'WARN', 'val/test sets may not contain both classes given minority class size; consider leave-one-run-out or collect more runs' FROM ab WHERE na < 5 OR nb < 5
UNION ALL SELECT CASE WHEN r >= 3 THEN 'WARN' ELSE 'INFO' END, CONCAT('window balance attack:benign = ', format('{:,}', aw), ':', format('{:,}', bw), ' (',
  printf('%.2f', CASE WHEN r >= 3 THEN r ELSE aw / bw END), ':1)', CASE WHEN r >= 3 THEN CONCAT('; consider more ', CASE WHEN bw < aw THEN 'benign' ELSE 'attack' END, ' data') ELSE '' END) FROM bal WHERE aw > 0 AND bw > 0
UNION ALL SELECT 'WARN', CONCAT('benign runs (', CAST(nb AS VARCHAR), ') < attack runs (', CAST(na AS VARCHAR), '); collect more benign runs') FROM ab WHERE nb < na AND nb > 0 AND (na <= 5 OR nb <= 5)
UNION ALL SELECT 'WARN', CONCAT('attack runs (', CAST(na AS VARCHAR), ') < benign runs (', CAST(nb AS VARCHAR), '); collect more attack runs') FROM ab WHERE na < nb AND na > 0 AND (na <= 5 OR nb <= 5)
UNION ALL SELECT 'INFO', CONCAT('shape `', shape, '` dominates ', CAST(CAST(ROUND_EVEN(w * 100.0 / (aw + bw), 0) AS BIGINT) AS VARCHAR), '% of windows; consider per-shape metrics or more diverse data')
  FROM sh, ab WHERE w / (aw + bw) >= 0.7""", runs=True)
def audit_warnings(spark, d):
    return audit.warnings(_per_run(spark, d))


# --- splits: every drone plays a run, so that the table grows with the data -------
_UNITS = """
units AS (SELECT CONCAT('run_', CAST(drone_id AS VARCHAR)) AS run_name, drone_id, MIN(run_label) AS run_label FROM flight GROUP BY drone_id)"""


def _quota_sql(source: str, name: str, seed: int) -> str:
    """Stratified hold-out of one fifth: largest remainder by class, hash order within it."""
    return f"""
{name}_c AS (SELECT run_label, COUNT(*) AS n FROM {source} GROUP BY run_label),
{name}_t AS (SELECT SUM(n) AS total, SUM(n) - CEIL(SUM(n) * 0.2) AS kept, COUNT(*) AS classes FROM {name}_c),
{name}_q AS (SELECT run_label, n, FLOOR(n * kept / total) AS base, n * kept / total - FLOOR(n * kept / total) AS frac, kept FROM {name}_c, {name}_t),
{name}_r AS (SELECT run_label, n - base - CASE WHEN ROW_NUMBER() OVER (ORDER BY frac DESC, run_label) <= kept - SUM(base) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_q),
{name} AS (SELECT u.*, ROW_NUMBER() OVER (PARTITION BY u.run_label ORDER BY sha256(CONCAT(run_name, ':{seed}')), run_name) <= r.quota AS held
  FROM {source} u JOIN {name}_r r ON r.run_label = u.run_label)"""


_SPLIT = (
    "WITH " + _UNITS.strip() + "," + _quota_sql("units", "first_cut", 42)
    + ",\nrest AS (SELECT run_name, drone_id, run_label FROM first_cut WHERE NOT held)," + _quota_sql("rest", "second_cut", 42)
    + """,
split AS (SELECT run_name, drone_id, run_label, CASE WHEN held THEN 'val' ELSE 'train' END AS split FROM second_cut
  UNION ALL SELECT run_name, drone_id, run_label, 'test' FROM first_cut WHERE held)"""
)


def units(f):
    return f.groupBy("drone_id").agg(F.min("run_label").alias("run_label")).select(
        F.concat(F.lit("run_"), F.col("drone_id").cast("string")).alias("run_name"), "drone_id", "run_label")


@query("D3 D5 H4", _SPLIT + " SELECT run_name, run_label, split FROM split")
def split_runs(spark, d):
    return splits.three_way_split(units(flight(spark, d))).select("run_name", "run_label", "split")


@query("D4 U7", _SPLIT + """,
lopsided AS (SELECT run_name, run_label, CASE WHEN split = 'val' AND run_label = 'benign' THEN 'train' ELSE split END AS split FROM split),
pick AS (SELECT MIN(run_name) AS run_name FROM lopsided WHERE split = 'train' AND run_label = 'benign')
SELECT l.run_name, run_label, CASE WHEN p.run_name IS NOT NULL THEN 'val' ELSE split END AS split,
  CASE WHEN p.run_name IS NOT NULL THEN CONCAT('patched: moved ', p.run_name, ' from train to val to add benign class') END AS note
FROM lopsided l LEFT JOIN pick p ON p.run_name = l.run_name""")
def split_quota_patch(spark, d):
    whole = splits.three_way_split(units(flight(spark, d))).select("run_name", "run_label", "split")
    # A split whose validation part lost its benign runs.
    lost = (F.col("split") == "val") & (F.col("run_label") == "benign")
    lopsided = whole.withColumn("split", F.when(lost, "train").otherwise(F.col("split")))
    return splits.patch_quota(lopsided)


@query("U4", _SPLIT + " SELECT run_name, 'train/val' AS pair FROM split WHERE FALSE")
def split_overlap(spark, d):
    return splits.check_split(splits.three_way_split(units(flight(spark, d))))


@query("U4", _SPLIT + """
SELECT run_name, split || '/test' AS pair FROM split WHERE drone_id % 3 = 0 AND split <> 'test'""")
def split_overlap_found(spark, d):
    split = splits.three_way_split(units(flight(spark, d)))
    # every third drone is in the test split as well
    return splits.check_split(split.unionByName(split.filter("drone_id % 3 = 0").withColumn("split", F.lit("test"))))


@query("J5 A24", _SPLIT + """
SELECT split, COUNT(*) FILTER (WHERE y = 0) AS benign, COUNT(*) FILTER (WHERE y = 1) AS attack
FROM (SELECT s.split, CASE WHEN f.run_label = 'attack' AND attack_type <> 'null' THEN 1 ELSE 0 END AS y FROM flight f JOIN split s ON s.drone_id = f.drone_id) x
GROUP BY split""")
def class_distribution(spark, d):
    f = flight(spark, d)
    split = splits.three_way_split(units(f))
    rows = splits.assign_split(windows.training_rows(f, "all"), split, "drone_id")
    return windows.class_distribution(rows)


@query("S19", _SPLIT + """
SELECT part, i, run_name FROM (SELECT split AS part, CAST(ROW_NUMBER() OVER (PARTITION BY split ORDER BY run_name) - 1 AS INTEGER) AS i, run_name FROM split) x""")
def split_manifest(spark, d):
    from skytrace.session import scratch_path
    from skytrace.sources import metadata

    path = scratch_path(spark, "manifest")
    split = splits.three_way_split(units(flight(spark, d)))
    metadata.write_manifest(split, path, {"split_seed": 42, "window_size": WINDOW, "stride": STEP, "primary_type": "ATTITUDE"})
    back = metadata.read_manifest(spark, path)
    parts = F.array(*[F.struct(F.lit(s).alias("part"), F.col(f"{s}_runs").alias("names")) for s in ("train", "val", "test")])
    return back.select(F.inline(parts)).select("part", F.posexplode("names").alias("i", "run_name"))


# --- scaling ----------------------------------------------------------------------
@query("A26", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, ROUND(AVG({c}), 6) AS mean, ROUND(CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END, 6) AS scale
FROM flight WHERE mav_packet_type = 'ATTITUDE' AND run_label = 'benign'""" for c in ("roll", "pitch", "yaw")))
def scaler_fit(spark, d):
    rows = S.primary(flight(spark, d), "ATTITUDE")
    return rounded(scaling.scaler_table(scaling.fit_scaler(rows, ["roll", "pitch", "yaw"], "train_benign")), "mean", "scale")


@query("J6 S11", """
WITH s AS (SELECT AVG(roll) AS ra, STDDEV_POP(roll) AS rs, AVG(pitch) AS pa, STDDEV_POP(pitch) AS ps FROM flight WHERE mav_packet_type = 'ATTITUDE')
SELECT drone_id, timestamp, ROUND((roll - ra) / rs, 6) AS roll, ROUND((pitch - pa) / ps, 6) AS pitch
FROM flight, s WHERE mav_packet_type = 'ATTITUDE'""")
def scaler_apply(spark, d):
    rows = capture.read_primary(flight(spark, d), "ATTITUDE", ["roll", "pitch"])
    stats = scaling.fit_scaler(rows, ["roll", "pitch"])
    out = rounded(scaling.apply_scaler(rows, stats, ["roll", "pitch"]), "roll", "pitch")
    return out.select("drone_id", F.col("timestamp").cast("long").alias("timestamp"), "roll", "pitch")


# --- balancing --------------------------------------------------------------------
@query("W14", """
SELECT run_id, drone_id, window_index, y_true FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY y_true ORDER BY sha256(CONCAT(CAST(run_id AS VARCHAR), '|', CAST(drone_id AS VARCHAR), '|', CAST(window_index AS VARCHAR), '|42'))) AS i,
    LEAST((SELECT COUNT(*) FROM pred WHERE y_true = 0), (SELECT COUNT(*) FROM pred WHERE y_true = 1)) AS quota FROM pred
) x WHERE i <= quota""", pred=True)
def undersampled_windows(spark, d):
    return windows.undersample(predictions(flight(spark, d))).select("run_id", "drone_id", "window_index", "y_true")


@query("A25", """
SELECT y_true AS label, COUNT(*) AS n, ROUND((SELECT COUNT(*) FROM pred) / (2.0 * COUNT(*)), 6) AS weight FROM pred GROUP BY y_true""", pred=True)
def class_weights(spark, d):
    return rounded(windows.class_weights(predictions(flight(spark, d))), "weight")
