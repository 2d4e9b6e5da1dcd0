"""Times the headline queries warm and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores and
``BENCH_RUNS`` the timed repetitions (the median counts). Every query runs once before
timing. Results go to Spark's no-op sink, so all columns of all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from skytrace.plans import QUERIES

HEADLINE = [
    # canned report
    "report_volume", "report_drone_stats", "report_label_histogram", "report_top_types",
    "report_hud_dynamics", "report_attitude_dynamics",
    # labelling and audit
    "label_rows", "audit_usable_rows", "audit_totals", "audit_class_extremes", "audit_shape_classes",
    # features and windows
    "features_attitude", "features_gps", "features_hud", "causal_windows", "undersampled_windows",
    # import
    "flight_table",
    # evaluation
    "confusion_matrix", "score_summary", "flight_hours", "run_metrics", "benign_rates",
    "attack_metrics", "worst_first_breakdown", "detection_delay", "threshold_sweep",
    "missed_streak_per_run", "onset_latency", "best_threshold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total_warm_median", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "spark": spark.version, "cores": cpus, "shuffle_partitions": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
