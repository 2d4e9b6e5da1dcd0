"""Detector evaluation over the stand-in predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skytrace.functions.scalars import primary
from skytrace.operators import metrics, splits, windows
from skytrace.plans.registry import query, r6, rounded
from skytrace.plans.views import flight, predictions, runs, stored_predictions

T = 0.5
_CM = f"""
COUNT(*) FILTER (WHERE y_prob >= {T} AND y_true = 1) AS tp, COUNT(*) FILTER (WHERE y_prob >= {T} AND y_true = 0) AS fp,
COUNT(*) FILTER (WHERE y_prob < {T} AND y_true = 1) AS fn, COUNT(*) FILTER (WHERE y_prob < {T} AND y_true = 0) AS tn"""
_PRF = """
ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
ROUND(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""
_PROB = """
ROUND(MIN(y_prob), 6) AS prob_min, ROUND(AVG(y_prob), 6) AS prob_mean, ROUND(QUANTILE_CONT(y_prob, 0.95), 6) AS prob_p95,
ROUND(QUANTILE_CONT(y_prob, 0.99), 6) AS prob_p99, ROUND(MAX(y_prob), 6) AS prob_max"""
_PROBS = ["prob_min", "prob_mean", "prob_p95", "prob_p99", "prob_max"]
_HOURS = """
spans AS (SELECT run_id, drone_id, run_label, MAX(window_end_timestamp) - MIN(window_start_timestamp) AS s FROM pred GROUP BY run_id, drone_id, run_label)"""


def _pred(spark, d):
    return predictions(flight(spark, d))


@query("W8 K1", "SELECT run_id, drone_id, window_index, row_start_index, row_end_index, window_start_timestamp, window_end_timestamp, y_true FROM pred", pred=True)
def causal_windows(spark, d):
    return _pred(spark, d).select("run_id", "drone_id", "window_index", "row_start_index", "row_end_index",
                                  "window_start_timestamp", "window_end_timestamp", "y_true")


@query("W8", """
SELECT run_id, drone_id, CAST((rn - 8) / 2 AS BIGINT) AS window_index, seq FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id, drone_id ORDER BY timestamp, seq) AS rn
  FROM (SELECT * REPLACE (NULLIF(drone_id, 1) AS drone_id) FROM flight WHERE mav_packet_type = 'ATTITUDE') a) b WHERE rn >= 8 AND (rn - 8) % 2 = 0""")
def windows_of_unknown_drones(spark, d):
    rows = primary(flight(spark, d), "ATTITUDE").withColumn("drone_id", F.nullif(F.col("drone_id"), F.lit(1)))
    return windows.causal_windows(rows, 8, 2, keep=["seq"]).select("run_id", "drone_id", "window_index", "seq")



@query("A14 A15", f"SELECT run_id, tp, fp, fn, tn, {_PRF} FROM (SELECT run_id, {_CM} FROM pred GROUP BY run_id) x", pred=True)
def confusion_matrix(spark, d):
    return rounded(metrics.prf(metrics.confusion(_pred(spark, d), T, ["run_id"])), "precision", "recall", "f1")


@query("A16 H11", f"SELECT run_id, {_PROB} FROM pred GROUP BY run_id", pred=True)
def score_summary(spark, d):
    return rounded(metrics.prob_summary(_pred(spark, d), ["run_id"]), *_PROBS)


@query("A17", "WITH " + _HOURS.strip() + " SELECT run_id, ROUND(SUM(CASE WHEN s > 0 THEN s ELSE 0 END) / 3600000.0, 6) AS flight_hours FROM spans GROUP BY run_id", pred=True)
def flight_hours(spark, d):
    return rounded(metrics.flight_hours(_pred(spark, d), ["run_id"]), "flight_hours")


@query("A18", "WITH " + _HOURS.strip() + f""",
m AS (SELECT run_id, COUNT(*) AS windows, COUNT(DISTINCT drone_id) AS scored, {_CM}, {_PROB} FROM pred GROUP BY run_id),
h AS (SELECT run_id, SUM(CASE WHEN s > 0 THEN s ELSE 0 END) / 3600000.0 AS hours FROM spans GROUP BY run_id)
SELECT r.run_id, r.run_label, r.drones, r.drones - COALESCE(scored, 0) AS skipped, COALESCE(windows, 0) AS windows, tp, fp, fn, tn,
  CASE WHEN m.run_id IS NOT NULL THEN ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) END AS precision,
  CASE WHEN m.run_id IS NOT NULL THEN ROUND(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) END AS recall,
  CASE WHEN m.run_id IS NOT NULL THEN ROUND(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) END AS f1,
  ROUND(hours, 6) AS flight_hours, ROUND((tp + fp) / windows, 6) AS predicted_positive_rate,
  CASE WHEN r.run_label = 'benign' THEN fp END AS false_positives,
  CASE WHEN r.run_label = 'benign' THEN ROUND(fp / windows, 6) END AS false_positive_rate,
  prob_min, prob_mean, prob_p95, prob_p99, prob_max
FROM runs r LEFT JOIN m ON m.run_id = r.run_id LEFT JOIN h ON h.run_id = r.run_id""", runs=True, pred=True)
def run_metrics(spark, d):
    f = flight(spark, d)
    out = metrics.run_metrics(stored_predictions(f), runs(f).select("run_id", "run_label", "drones"), T)
    return rounded(out, "precision", "recall", "f1", "flight_hours", "predicted_positive_rate", "false_positive_rate", *_PROBS)


@query("A19", "WITH " + _HOURS.strip() + f"""
SELECT {T}::DOUBLE AS threshold, windows, drones, tp, fp, fn, tn, ROUND(hours, 6) AS flight_hours, ROUND(fp / windows, 6) AS fpr,
  ROUND(fp / windows * 1e4, 6) AS fp_per_10k_windows, ROUND(fp / drones, 6) AS fp_per_drone, ROUND(fp / hours, 6) AS fp_per_flight_hour,
  prob_min, prob_mean, prob_p95, prob_p99, prob_max
FROM (SELECT COUNT(*) AS windows, {_CM}, {_PROB} FROM pred WHERE run_label = 'benign') m,
  (SELECT CAST(SUM(drones) AS BIGINT) AS drones FROM runs WHERE run_label = 'benign') n,
  (SELECT SUM(CASE WHEN s > 0 THEN s ELSE 0 END) / 3600000.0 AS hours FROM spans WHERE run_label = 'benign') h""", runs=True, pred=True)
def benign_rates(spark, d):
    f = flight(spark, d)
    out = metrics.benign_rates(stored_predictions(f), T, runs(f).select("run_id", "drones"))
    return rounded(out, "flight_hours", "fpr", "fp_per_10k_windows", "fp_per_drone", "fp_per_flight_hour", *_PROBS)


@query("A20", f"""
SELECT attack_type, {T}::DOUBLE AS threshold, n_runs, windows, tp, fp, fn, tn, {_PRF}, prob_min, prob_mean, prob_p95, prob_p99, prob_max
FROM (SELECT attack_type, COUNT(DISTINCT run_id) AS n_runs, COUNT(*) AS windows, {_CM}, {_PROB} FROM pred WHERE run_label = 'attack' GROUP BY attack_type) x""", pred=True)
def attack_metrics(spark, d):
    out = metrics.attack_metrics(stored_predictions(flight(spark, d)), T, ["attack_type"])
    return rounded(out, "precision", "recall", "f1", *_PROBS)


@query("A21 K3", f"""
SELECT level, run_id, drone_id, ROUND(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 'nan'::DOUBLE END, 6) AS precision,
  ROUND(tp / (tp + fn), 6) AS recall, ROUND(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 'nan'::DOUBLE END, 6) AS f1, tp + fn AS support
FROM (SELECT CASE WHEN GROUPING(drone_id) = 1 THEN 'run' ELSE 'drone' END AS level, run_id, drone_id, {_CM}
  FROM pred GROUP BY GROUPING SETS ((run_id), (run_id, drone_id))) x WHERE tp + fn > 0""", pred=True)
def worst_first_breakdown(spark, d):
    return rounded(metrics.breakdown(_pred(spark, d), T), "precision", "recall", "f1")


_DELAY = f"""
delay AS (SELECT run_id, MIN(window_end_timestamp) FILTER (WHERE y_prob >= {T}) - MIN(window_start_timestamp) AS delay_ms FROM pred WHERE y_true = 1 GROUP BY run_id)"""


@query("A23", "WITH " + _DELAY.strip() + " SELECT * FROM delay", pred=True)
def detection_delay(spark, d):
    return metrics.detection_delay(_pred(spark, d), T)


@query("A23", "WITH " + _DELAY.strip() + """
SELECT ROUND(AVG(delay_ms), 6) AS mean_delay_ms, MEDIAN(delay_ms) AS median_delay_ms, COUNT(*) FILTER (WHERE delay_ms IS NULL) AS undetected_runs FROM delay""", pred=True)
def detection_summary(spark, d):
    return rounded(metrics.detection_summary(_pred(spark, d), T), "mean_delay_ms")


_SWEEP = [0.1, 0.25, 0.5, 0.75, 0.95]
_GRID = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in _SWEEP) + ") AS g(threshold)"
_CM_T = """
COUNT(*) FILTER (WHERE y_prob >= threshold AND y_true = 1) AS tp, COUNT(*) FILTER (WHERE y_prob >= threshold AND y_true = 0) AS fp,
COUNT(*) FILTER (WHERE y_prob < threshold AND y_true = 1) AS fn, COUNT(*) FILTER (WHERE y_prob < threshold AND y_true = 0) AS tn, COUNT(*) AS windows"""


@query("J7", f"SELECT attack_type, threshold, windows, tp, fp, fn, tn, {_PRF} FROM (SELECT attack_type, threshold, {_CM_T} FROM pred, {_GRID} GROUP BY attack_type, threshold) x", pred=True)
def threshold_sweep(spark, d):
    return rounded(metrics.threshold_sweep(_pred(spark, d), _SWEEP, ["attack_type"]), "precision", "recall", "f1")


@query("J7 A19", "WITH " + _HOURS.strip() + f"""
SELECT threshold, windows, tp, fp, fn, tn, drones, ROUND(hours, 6) AS flight_hours, ROUND(fp / windows, 6) AS fpr, ROUND(fp / windows * 1e4, 6) AS fp_per_10k_windows,
  ROUND(fp / drones, 6) AS fp_per_drone, ROUND(fp / hours, 6) AS fp_per_flight_hour
FROM (SELECT threshold, {_CM_T} FROM pred, {_GRID} WHERE run_label = 'benign' GROUP BY threshold) x,
  (SELECT COUNT(*) AS drones, SUM(CASE WHEN s > 0 THEN s ELSE 0 END) / 3600000.0 AS hours FROM spans WHERE run_label = 'benign') h""", pred=True)
def benign_sweep(spark, d):
    return rounded(metrics.benign_sweep(_pred(spark, d), _SWEEP), "flight_hours", "fpr", "fp_per_10k_windows", "fp_per_drone", "fp_per_flight_hour")


def _streak_sql(keys: str, order: str) -> str:
    return f"""
SELECT {keys}, MAX(n) AS max_streak FROM (
  SELECT {keys}, island, COUNT(*) FILTER (WHERE y_prob < {T}) AS n FROM (
    SELECT *, SUM(CASE WHEN y_prob >= {T} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS island
    FROM pred WHERE y_true = 1) a GROUP BY {keys}, island) b GROUP BY {keys}"""


@query("W10", _streak_sql("run_id", "window_end_timestamp, window_index, drone_id"), pred=True)
def missed_streak_per_run(spark, d):
    return metrics.fn_streak(_pred(spark, d), T)


@query("W10", _streak_sql("run_id, drone_id", "window_end_timestamp, window_index"), pred=True)
def missed_streak_per_drone(spark, d):
    return metrics.fn_streak(_pred(spark, d), T, ["run_id", "drone_id"])


@query("W11", f"""
WITH p AS (SELECT y_prob, NTILE(3) OVER (PARTITION BY run_id ORDER BY window_end_timestamp, drone_id, window_index) AS i,
  ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY window_end_timestamp, drone_id, window_index) - 1 AS pos, COUNT(*) OVER (PARTITION BY run_id) AS n FROM pred WHERE y_true = 1),
c AS (SELECT LEAST(pos * 3 // n, 2) AS t FROM p WHERE y_prob < {T})
SELECT position, COUNT(t) AS misses, ROUND(COALESCE(COUNT(t) * 100.0 / NULLIF((SELECT COUNT(*) FROM c), 0), 0), 6) AS pct
FROM (VALUES ('onset', 0), ('middle', 1), ('end', 2)) AS v(position, i) LEFT JOIN c ON c.t = v.i GROUP BY position""", pred=True)
def missed_positions(spark, d):
    return rounded(metrics.fn_positions(_pred(spark, d), T), "pct")


_ONSET = f"""
o AS (SELECT run_id, drone_id, window_end_timestamp AS e, y_prob >= {T} AS hit,
  ROW_NUMBER() OVER (PARTITION BY run_id, drone_id ORDER BY window_end_timestamp, window_index) - 1 AS i FROM pred WHERE y_true = 1),
lat AS (SELECT run_id, drone_id, MIN(i) FILTER (WHERE hit) AS windows_after_onset, (MIN(e) FILTER (WHERE hit) - MIN(e)) / 1000.0 AS seconds_after_onset FROM o GROUP BY run_id, drone_id)"""


@query("W12", "WITH " + _ONSET.strip() + " SELECT run_id, drone_id, windows_after_onset, ROUND(seconds_after_onset, 6) AS seconds_after_onset FROM lat", pred=True)
def onset_latency(spark, d):
    return rounded(metrics.onset_latency(_pred(spark, d), T), "seconds_after_onset")


@query("W12", "WITH " + _ONSET.strip() + """
SELECT ROUND(AVG(windows_after_onset), 6) AS mean_windows, CAST(FLOOR(MEDIAN(windows_after_onset)) AS BIGINT) AS median_windows,
  ROUND(AVG(seconds_after_onset), 6) AS mean_seconds, ROUND(MEDIAN(seconds_after_onset), 6) AS median_seconds FROM lat""", pred=True)
def onset_summary(spark, d):
    latency = metrics.onset_latency(_pred(spark, d), T)
    return rounded(metrics.onset_summary(latency), "mean_windows", "mean_seconds", "median_seconds")


_CURVE = """
s AS (SELECT y_prob, COUNT(*) AS n, SUM(y_true) AS pos FROM pred GROUP BY y_prob),
c AS (SELECT y_prob AS threshold, SUM(pos) OVER w AS tp, SUM(n) OVER w AS pp, SUM(pos) OVER () AS p FROM s WINDOW w AS (ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT threshold, tp / pp AS precision, tp / p AS recall, 2 * (tp / pp) * (tp / p) / (tp / pp + tp / p + 1e-9) AS f1 FROM c)"""


@query("W13 H6", "WITH " + _CURVE.strip() + " SELECT threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM f", pred=True)
def precision_recall_curve(spark, d):
    return rounded(metrics.pr_curve(_pred(spark, d)), "precision", "recall", "f1")


@query("W13", "WITH " + _CURVE.strip() + " SELECT threshold, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1", pred=True)
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(_pred(spark, d)), "precision", "recall", "f1")


_LINE = f"windows, tp, fp, fn, tn, {_PRF}"
_T_ALL = f"SELECT run_label, threshold, {_CM_T} FROM pred, {_GRID} GROUP BY run_label, threshold"
_T_TYPE = f"SELECT attack_type, threshold, {_CM_T} FROM pred, {_GRID} WHERE run_label = 'attack' GROUP BY attack_type, threshold"


@query("S20", f"""
SELECT 'per_run' AS section, CAST(run_id AS VARCHAR) AS name, NULL::DOUBLE AS threshold, {_LINE} FROM (SELECT run_id, COUNT(*) AS windows, {_CM} FROM pred GROUP BY run_id) a
UNION ALL SELECT 'aggregate_primary', run_label, threshold, {_LINE} FROM ({_T_ALL}) b WHERE threshold = {T}
UNION ALL SELECT 'threshold_sweep', run_label, threshold, {_LINE} FROM ({_T_ALL}) c
UNION ALL SELECT 'per_attack_type_primary', attack_type, threshold, {_LINE} FROM ({_T_TYPE}) d WHERE threshold = {T}
UNION ALL SELECT 'per_attack_type_sweep', attack_type, threshold, {_LINE} FROM ({_T_TYPE}) e
UNION ALL SELECT 'excluded_runs', run_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM runs WHERE run_id >= 8
UNION ALL SELECT 'settings', 'ATTITUDE', {T}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""", runs=True, pred=True)
def evaluation_report(spark, d):
    from skytrace.session import scratch_path
    from skytrace.sources import metadata

    f = flight(spark, d)
    dim = runs(f)
    sections = metrics.report(stored_predictions(f), dim.select("run_id", "run_label", "drones"), _SWEEP, T, dim.filter("run_id >= 8"))
    path = scratch_path(spark, "evaluation")
    metadata.write_report(sections, path, {"primary_type": "ATTITUDE", "primary_threshold": T})
    # read back from the JSON bodies
    fields = ("run_id string, run_label string, attack_type string, run_name string, primary_type string, primary_threshold double, "
              "threshold double, windows long, tp long, fp long, fn long, tn long, precision double, recall double, f1 double")
    body = spark.read.text(path).select("section", F.from_json("value", fields).alias("b")).select("section", "b.*")
    name = F.when(F.col("section") == "per_run", F.col("run_id")).when(F.col("section").startswith("per_attack"), F.col("attack_type"))
    out = body.select("section", F.coalesce(name, "run_name", "primary_type", "run_label").alias("name"), F.coalesce("threshold", "primary_threshold").alias("threshold"),
                      "windows", "tp", "fp", "fn", "tn", "precision", "recall", "f1")
    return rounded(out, "precision", "recall", "f1")


@query("S15 S21 D6 D7 K4", f"""
WITH m AS (SELECT run_id, {_CM} FROM pred GROUP BY run_id),
t AS (SELECT run_id, printf('%.2f', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END) AS p, tp + fn AS support FROM m)
SELECT 'model' || CAST(run_id % 2 + 1 AS VARCHAR) AS model, CAST(run_id + 1 AS INTEGER) AS window_size, 2 AS stride, CAST(p AS DOUBLE) AS val_attack_f1, CAST(p AS DOUBLE) AS test_attack_f1,
  CAST(support AS INTEGER) AS test_attack_support, 0.25::DOUBLE AS best_threshold
FROM t UNION ALL SELECT 'model' || CAST((run_id + 1) % 2 + 1 AS VARCHAR), CAST(run_id + 1 AS INTEGER), 2, NULL, NULL, NULL, NULL FROM t""", pred=True)
def sweep_summary(spark, d):
    from skytrace.session import scratch_path
    from skytrace.sources import logs
    from skytrace.sources.files import put

    # One console text per run with its metrics in the layout trainers print.
    m = metrics.prf(metrics.confusion(_pred(spark, d), T, ["run_id"]))
    shown = F.format_string("%.2f", "precision")
    line = F.concat(F.lit("      Attack     "), shown, F.lit("   0.50   "), shown, F.lit("    "), (F.col("tp") + F.col("fn")).cast("string"), F.lit("\n"))
    text = F.concat(F.lit("Optimal threshold (from val) : 0.25\n"), line, F.lit("== TEST ==\n"), line)
    tag = F.format_string("model%d_w%d_s2", F.col("run_id") % 2 + 1, F.col("run_id") + 1)
    console = scratch_path(spark, "logs")
    for name, said in m.select(tag, text).collect():  # a console text per run
        put(spark, f"{console}/{name}.log", said.encode())
    parsed = logs.parse_train_logs(spark, console)
    grid = splits.sweep_grid(spark, ["model1", "model2"], [(w, 2) for w in range(1, 11)])
    path = scratch_path(spark, "sweep")
    logs.write_sweep_summary(splits.collate_sweep(grid, parsed), path)
    schema = {"window_size": "int", "stride": "int", "test_attack_support": "int"}
    back = spark.read.option("header", "true").csv(path)
    cols = ["model", "window_size", "stride", "val_attack_f1", "test_attack_f1", "test_attack_support", "best_threshold"]
    return back.select(*[F.col(c).cast(schema.get(c, "string" if c == "model" else "double")).alias(c) for c in cols])
