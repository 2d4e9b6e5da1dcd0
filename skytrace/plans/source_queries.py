"""File sources and sinks, import checks, cache: written from and read back into the tables' rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skytrace import fixed_values as fixed
from skytrace.operators import features, labeling
from skytrace.plans.registry import query, r6, rounded
from skytrace.plans.views import bronze, flight, runs
from skytrace.session import scratch_path
from skytrace.sources import cache, capture, files, logs, metadata


def _written_capture(spark, d):
    root = scratch_path(spark, "capture")
    capture.write_capture(bronze(spark, d).drop("run_id", "run_label", "run_attack"), root)
    return root


@query("S1 S2 P1", """
SELECT run_name, CAST(drone_id AS INTEGER) AS drone_id, CAST(seq AS VARCHAR) AS seq, mav_packet_type, attack_type,
  CAST(timestamp AS VARCHAR) AS timestamp, COALESCE(CAST(fix_type AS VARCHAR), 'null') AS fix_type FROM flight""")
def capture_scan(spark, d):
    rows = capture.read_capture(spark, _written_capture(spark, d))
    return rows.select("run_name", "drone_id", "seq", "mav_packet_type", "attack_type", "timestamp", "fix_type")


@query("S7 A13", "SELECT run_name, COUNT(DISTINCT drone_id) AS drones FROM flight GROUP BY run_name")
def discovered_runs(spark, d):
    return capture.discover_runs(spark, _written_capture(spark, d))


@query("S3 S6 S11 P7", """
SELECT run_name, CAST(drone_id AS INTEGER) AS drone_id, CAST(timestamp AS DOUBLE) AS timestamp, attack_type, roll, pitch
FROM flight WHERE mav_packet_type = 'ATTITUDE'""")
def flight_table(spark, d):
    out = scratch_path(spark, "flight")
    capture.convert_all(spark, _written_capture(spark, d), out)
    rows = capture.read_primary(capture.read_flight(spark, out), "ATTITUDE", ["roll", "pitch"])
    return rows.select("run_name", "drone_id", "timestamp", "attack_type", "roll", "pitch")


@query("S1", """
SELECT run_name, CAST(drone_id AS INTEGER) AS drone_id, CAST(seq AS VARCHAR) AS seq, CASE WHEN run_label = 'benign' THEN COALESCE(CAST(fix_type AS VARCHAR), 'null') END AS fix_type,
  CASE WHEN run_label <> 'benign' THEN mav_packet_type END AS mav_packet_type FROM flight""")
def captures_with_other_headers(spark, d):
    root, rows = scratch_path(spark, "capture"), bronze(spark, d)
    hidden = ["run_id", "run_label", "run_attack"]
    capture.write_capture(rows.filter("run_label = 'benign'").drop(*hidden, "mav_packet_type"), f"{root}/old")
    capture.write_capture(rows.filter("run_label <> 'benign'").drop(*hidden, "fix_type"), f"{root}/new")
    return capture.read_capture(spark, root).select("run_name", "drone_id", "seq", "fix_type", "mav_packet_type")


@query("S3", """
SELECT run_name, seq, CASE WHEN run_label = 'benign' THEN fix_type END AS fix_type, CASE WHEN run_label <> 'benign' THEN type END AS type FROM flight""")
def imports_with_other_columns(spark, d):
    out, rows = scratch_path(spark, "flight"), flight(spark, d).withColumn("drone_id", F.col("drone_id").cast("int"))
    capture.to_flight(rows.filter("run_label = 'benign'").drop("type"), out)
    capture.to_flight(rows.filter("run_label <> 'benign'").drop("fix_type"), out)
    return capture.read_flight(spark, out).select("run_name", "seq", "fix_type", "type")


@query("S6", "SELECT run_name, CASE WHEN run_label = 'benign' THEN 'skipped' ELSE 'built' END AS status FROM runs", runs=True)
def conversion_skips_built_runs(spark, d):
    out = scratch_path(spark, "flight")
    rows = bronze(spark, d)
    capture.to_flight(rows.filter("run_label = 'benign'"), out)
    return capture.to_flight(rows, out)


@query("S9 S10 A7", """
SELECT run_name, attack, 'scan' AS converter, mav_packet_type, COUNT(*) AS rows FROM (SELECT *, run_attack AS attack FROM flight) f
GROUP BY run_name, attack, mav_packet_type""")
def run_metadata(spark, d):
    f = flight(spark, d)
    out = scratch_path(spark, "metadata")
    dim = runs(f).select("run_name", "attack").withColumn("converter", F.lit("scan"))
    metadata.write_metadata(metadata.with_row_counts(dim, f), out)
    good, _ = metadata.read_metadata(spark, out, "*.json")
    return good.select("run_name", "attack", "converter", F.explode("row_counts").alias("mav_packet_type", "rows"))


@query("J11 A22 S5", """
SELECT run_name, COUNT(*) AS src_rows, COUNT(*) FILTER (WHERE mav_packet_type <> 'STATUSTEXT' OR run_label = 'attack') AS rows,
  COUNT(DISTINCT drone_id) AS src_drones,
  COUNT(DISTINCT drone_id) FILTER (WHERE mav_packet_type <> 'STATUSTEXT' OR run_label = 'attack') AS drones,
  CAST(0 AS BIGINT) AS no_drone, COUNT(*) FILTER (WHERE run_label = 'attack' AND attack_type <> 'null') AS other_label,
  CONCAT_WS(',', CASE WHEN COUNT(*) <> COUNT(*) FILTER (WHERE mav_packet_type <> 'STATUSTEXT' OR run_label = 'attack') THEN 'row count' END,
    CASE WHEN COUNT(DISTINCT drone_id) <> COUNT(DISTINCT drone_id) FILTER (WHERE mav_packet_type <> 'STATUSTEXT' OR run_label = 'attack') THEN 'drone count' END,
    CASE WHEN COUNT(*) FILTER (WHERE run_label = 'attack' AND attack_type <> 'null') > 0 THEN 'label' END) AS violations
FROM flight GROUP BY run_name""")
def import_verification(spark, d):
    f = flight(spark, d)
    benign = F.col("run_label") == "benign"
    # An import that lost a message type of benign runs and kept row labels of attack runs.
    kept = f.filter(~benign | (F.col("mav_packet_type") != "STATUSTEXT"))
    constant = labeling.with_constant_label(kept.filter(benign))
    written = constant.unionByName(kept.filter(~benign))
    out = capture.verify_import(f, written, F.lit(fixed.NULL_TEXT))
    return out.withColumn("violations", F.array_join("violations", ","))


def _written_legacy(spark, d):
    """Benign runs in the older layout: a folder per run, in it a folder per drone with a file per message type."""
    root = scratch_path(spark, "legacy")
    rows = bronze(spark, d).filter("run_label = 'benign'")
    rows = rows.withColumn("source", F.concat(F.lit("Nominal-"), F.col("run_id"))).withColumn("unit", F.concat("source", F.lit("-"), F.col("drone_id")))
    cells = ["mav_packet_type", "timestamp", "seq", "roll"]
    rows.select("source", "unit", *cells).repartition("source", "unit").write.partitionBy("source", "unit").option("header", "true").csv(root)
    return root


@query("S8", """
SELECT DISTINCT 'source=Nominal-' || CAST(run_id AS VARCHAR) AS source, 'run_legacy-nominal-' || CAST(run_id AS VARCHAR) || '_none_legacy' AS run_name FROM flight WHERE run_label = 'benign'""")
def legacy_discovered(spark, d):
    return capture.discover_legacy(spark, _written_legacy(spark, d), "benign").select("source", "run_name")


@query("S4", """
SELECT CAST(drone_id AS INTEGER) AS drone_id, mav_packet_type, CAST(timestamp AS VARCHAR) AS timestamp, CAST(seq AS VARCHAR) AS seq, COALESCE(CAST(roll AS VARCHAR), 'null') AS roll
FROM flight WHERE run_label = 'benign' AND mav_packet_type <> 'ATTITUDE'""")
def legacy_scan(spark, d):
    rows = capture.read_legacy(spark, _written_legacy(spark, d))
    return rows.filter("mav_packet_type <> 'ATTITUDE'").select("drone_id", "mav_packet_type", "timestamp", "seq", "roll")


@query("S4 J11", """
SELECT 'run_legacy-nominal-' || CAST(run_id AS VARCHAR) || '_none_legacy' AS run_name, COUNT(*) AS src_rows, COUNT(*) AS rows,
  COUNT(DISTINCT drone_id) AS src_drones, COUNT(DISTINCT drone_id) AS drones, '' AS violations FROM flight WHERE run_label = 'benign' GROUP BY run_id""")
def legacy_import(spark, d):
    out = capture.import_legacy(spark, _written_legacy(spark, d), "benign", scratch_path(spark, "flight"))
    return out.select("run_name", "src_rows", "rows", "src_drones", "drones", F.array_join("violations", ",").alias("violations"))


@query("S17", """
SELECT mav_packet_type || '.BIN' AS name, COUNT(*) / 1048576.0::DOUBLE AS size_mb FROM flight GROUP BY mav_packet_type
UNION ALL SELECT NULL, COUNT(*) / 1048576.0::DOUBLE FROM flight""")
def archived_log_sizes(spark, d):
    root = scratch_path(spark, "archive")
    for kind, n in flight(spark, d).groupBy("mav_packet_type").count().collect():  # a file per message type, a byte per row
        files.put(spark, f"{root}/{kind}.BIN", bytes(n))
    return logs.log_inventory(spark, root).select("name", "size_mb")


@query("A27", """
WITH e AS (SELECT sha256(CONCAT('run_', CAST(run_id AS VARCHAR), '/', CAST(seq AS VARCHAR), '|', CAST(timestamp AS VARCHAR), '|', CAST(k AS VARCHAR))) AS h FROM flight),
a AS (SELECT CONCAT(h[1:4], sha256(string_agg(h, '' ORDER BY h))) AS g FROM e GROUP BY h[1:4]),
b AS (SELECT CONCAT(g[1:2], sha256(string_agg(g, '' ORDER BY g))) AS g FROM a GROUP BY g[1:2]),
c AS (SELECT sha256(string_agg(g, '' ORDER BY g)) AS g FROM b)
SELECT sha256(CONCAT('{"primary_type": "ATTITUDE", "version": 2}', '|', g))[1:16] AS fingerprint FROM c""")
def input_fingerprint(spark, d):
    path = F.concat(F.lit("run_"), F.col("run_id").cast("string"), F.lit("/"), F.col("seq").cast("string"))
    files = flight(spark, d).select(path.alias("path"), F.col("timestamp").alias("mtime"), F.col("k").alias("size"))
    return cache.fingerprint(files, {"primary_type": "ATTITUDE"})


@query("S22", """
SELECT run_label, COUNT(*) AS rows, ROUND(SUM(roll), 4) AS roll FROM flight WHERE mav_packet_type = 'ATTITUDE' GROUP BY run_label""")
def preprocessed_cache(spark, d):
    f = flight(spark, d)
    root = scratch_path(spark, "cache")
    build = lambda: features.engineer(f, "ATTITUDE", keep=["run_label"]).withColumn("split", F.col("run_label"))

    def refuse():
        raise AssertionError("a finished cache entry is not rebuilt")

    cache.cached(spark, root, "a1b2", build)
    again = cache.cached(spark, root, "a1b2", refuse)
    out = again.groupBy("run_label").agg(F.count(F.lit(1)).alias("rows"), F.sum("roll").alias("roll"))
    return out.withColumn("roll", F.round("roll", 4))
