"""Cells, names, labels, audit rules and splits on small hand-made frames."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType

from skytrace import fixed_values as fixed
from skytrace.functions import scalars as S
from skytrace.operators import audit, labeling, reports, scaling, sets, splits, windows


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_format_cell(spark):
    r = one(
        spark, none=S.format_cell(F.lit(None).cast("string")), text=S.format_cell(F.lit("a,b\nc")),
        yes=S.format_cell(F.lit(True), BooleanType()), no=S.format_cell(F.lit(None).cast("boolean"), BooleanType()),
        arr=S.format_cell(F.array(F.lit("x"), F.lit(None), F.lit("y,z")), ArrayType(StringType())),
        raw=S.format_cell(F.lit(bytearray([0, 10, 255])), BinaryType()),
    )
    assert r.asDict() == {"none": "null", "text": "a;b c", "yes": "True", "no": "null", "arr": "x;null;y;z", "raw": "0;10;255"}


def test_null_text_and_casts(spark):
    df = spark.createDataFrame([("null",), ("NULL",), (None,), ("gps",), ("1.5",)], "c string")
    got = df.select(S.is_labelled("c").alias("l"), S.num("c").alias("n")).collect()
    assert [r["l"] for r in got] == [False, False, False, True, True]
    assert [r["n"] for r in got] == [None, None, None, None, 1.5]
    assert one(spark, ms=S.to_millis(F.lit(1.2349)))["ms"] == 1234


def test_run_names(spark):
    names = ["run_2024_none_n50_s60_e1200", "run_2024_attitude_spoof_n50_s60_e1200", "run_x", "run_legacy-nominal-3_none_legacy"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(S.run_shape("n")).collect()] == ["n50_s60_e1200", "spoof_n50_s60_e1200", "unknown", "legacy"]
    assert [r[0] for r in df.select(S.run_shape("n", strict=True)).collect()] == ["n50_s60_e1200"] * 2 + ["unknown"] * 2
    kinds = spark.createDataFrame([("None",), ("none",), ("gps_spoof",), (None,)], "a string")
    assert [r[0] for r in kinds.select(S.run_class("a")).collect()] == ["benign", "benign", "attack", "attack"]
    r = one(spark, a=S.attack_type_of(F.lit("VFR-HUD-spoof")), b=S.attack_type_of(F.lit("My-Odd")), n=S.run_number(F.lit("Nominal-11")), m=S.run_number(F.lit("x")),
            d=S.dst_run_name(F.lit("attack"), F.lit("gps-spoof"), F.lit("Run-4")), e=S.dst_run_name(F.lit("benign"), F.lit(None).cast("string"), F.lit("Nominal")))
    assert list(r) == ["vfr_hud_spoof", "my_odd", 11, None, "run_legacy-gpsspoof-4_gps_spoof_legacy", "run_legacy-nominal-0_none_legacy"]


def test_physics(spark):
    r = one(spark, h=S.heading_deg(F.lit(-0.5)), c=S.clamp(F.lit(140), 0, 100), n=S.clamp(F.lit(None).cast("double"), 0, 100),
            f=S.firmware_version(F.lit(0x04030201)), a=S.is_armed(F.lit(129)), b=S.is_armed(F.lit(64)), v=S.protocol_version(F.lit(0xFE)),
            w=S.n_windows(F.lit(80), 80, 2), x=S.n_windows(F.lit(79), 80, 2), y=S.n_windows(F.lit(85), 80, 2), m=S.magnitude(F.lit(3.0), F.lit(4.0)))
    assert abs(r["h"] - 331.352) < 1e-3
    assert list(r)[1:] == [100.0, None, "2.3.4", True, False, 1, 1, 0, 3, 5.0]
    rows = [(47.0, 8.0, 3), (0.0, 0.0, 3), (95.0, 8.0, 3), (47.0, 8.0, 1), (None, 8.0, 3), (47.0, 8.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double, gps_fix_type int")
    assert [r["lat"] for r in S.sanitize_position(df).collect()] == [47.0, None, None, None, None, 47.0]
    s = S.drop_sentinels(spark.createDataFrame([(-1, -1, 255), (12000, 250, 80)], "voltage_battery int, current_battery int, battery_remaining int")).collect()
    assert list(s[0]) == [None, None, None] and list(s[1]) == [12000, 250, 80]


def test_capture_columns(spark):
    dictionary = spark.createDataFrame([(1, ["seq", "roll", "alt"]), (2, ["lat", "alt"])], "msgid int, fields array<string>")
    assert [r[0] for r in S.payload_union(dictionary).collect()] == ["alt", "lat", "roll"]
    wide = S.canonical_columns(spark.createDataFrame([("A", "1")], "mav_packet_type string, roll string"), ["roll", "alt"])
    assert wide.columns[:3] == fixed.IDENTITY_FIELDS and wide.columns[13:15] == ["alt", "roll"] and wide.columns[-2:] == fixed.TRAILER_FIELDS
    assert len(wide.columns) == 3 + 10 + 2 + 18 + 7 + 16 + 2 and wide.first()["alt"] == "null"
    num = S.numeric_only(spark.createDataFrame([(1, 2.0, "x", None)], "seq int, roll double, note string, alt double"))
    assert num.columns == ["roll", "alt"] and num.first()["alt"] == 0.0


def test_feature_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "roll double, time_boot_ms double")
    with pytest.raises(ValueError, match="clock"):
        S.validate_features(df, ["roll"])
    with pytest.raises(ValueError, match="missing"):
        S.validate_features(df.select("roll"), ["roll", "pitch"])


# --- labels ---------------------------------------------------------------
@pytest.mark.parametrize("bucket", [5.0, 3600.0])
def test_label_rows(spark, bucket):
    windows_df = spark.createDataFrame(
        [(0, 10.0, 20.0, [1, 2], "a"), (1, 15.0, 30.0, [1, 1], "b"), (2, 50.0, 40.0, [1], "never")],
        "window_idx int, start_epoch double, end_epoch double, target_drones array<int>, attack_type string")
    rows = spark.createDataFrame(
        [(1, 10.0, 1), (2, 20.0, 1), (3, 20.0001, 1), (4, 30.0, 1), (5, 30.1, 1), (6, 25.0, 2), (7, 15.0, 3), (8, 15.0, None), (9, 45.0, 1), (9, 45.0, 1)],
        "id int, frame_timestamp double, drone_id int")
    got = labeling.label_rows(rows, windows_df, bucket_s=bucket).orderBy("id").collect()
    assert [r["attack_type"] for r in got] == ["a", "a", "b", "b", None, None, None, None, None, None]


def test_run_joins(spark):
    runs = spark.createDataFrame([("r1", "none"), ("r2", None), ("r3", "gps_spoof")], "run_name string, attack string")
    manifest = spark.createDataFrame([(["/x/r1", "r9/"], None, ["r2"])], "train_runs array<string>, val_runs array<string>, test_runs array<string>")
    assert [r["run_name"] for r in labeling.exclude_seen(runs, manifest).collect()] == ["r3"]
    assert labeling.whitelist(runs, ["r3", "zz"]).count() == 1
    assert {r["run_name"]: r["run_label"] for r in labeling.with_run_class(runs).collect()} == {"r1": "benign", "r2": "attack", "r3": "attack"}
    rows, dropped = labeling.attach_runs(spark.createDataFrame([("r1",), ("r8",), ("r8",)], "run_name string"), runs, "run_name")
    assert rows.count() == 1 and [r[0] for r in dropped.collect()] == ["r8"]


# --- reports --------------------------------------------------------------
def test_report_rounds_half_to_even_and_keeps_null_labels(spark):
    rows = [("A", 1)] * 3 + [("A", 2)] * 2 + [("B", 1)] + [("B", 2)] * 6 + [(None, 1)] + [("C", None)] * 4
    df = spark.createDataFrame(rows, "mav_packet_type string, drone_id int").withColumn("attack_type", F.lit(None).cast("string"))
    assert [tuple(r) for r in reports.top_types(df).collect()] == [("B", 7, 4), ("A", 5, 2), ("C", 4, None)]
    assert tuple(reports.volume(df).first()) == (17, 2)
    assert reports.label_histogram(df).first()["rows"] == 17


# --- audit ----------------------------------------------------------------
def per_run(spark, rows):
    return spark.createDataFrame(rows, "run_id int, run_name string, run_label string, shape string, rows long, windows long, below_window boolean")


def messages(df):
    return [(r["severity"], r["message"]) for r in df.collect()]


def test_warnings_small_and_lopsided(spark):
    table = per_run(spark, [(1, "run_a", "attack", "s1", 900, 900, False), (2, "run_b", "attack", "s1", 5, 0, True), (3, "run_c", "benign", "s2", 100, 100, False)])
    got = messages(audit.warnings(table, spark.createDataFrame([("run_x", "metadata"), ("run_y", "flight"), ("run_z", "flight")], "run_name string, reason string")))
    assert got == [
        ("SEVERE", "attack class has 2 run(s) — not enough for run-level train/val/test (need ≥3)"),
        ("SEVERE", "benign class has 1 run(s) — not enough for run-level train/val/test (need ≥3)"),
        ("WARN", "1 run(s) have rows < window_size (produce 0 windows): run_b"),
        ("WARN", "shape `s1` exists only in attack class"),
        ("WARN", "shape `s2` exists only in benign class"),
        ("WARN", "val/test sets may not contain both classes given minority class size; consider leave-one-run-out or collect more runs"),
        ("WARN", "window balance attack:benign = 900:100 (9.00:1); consider more benign data"),
        ("WARN", "benign runs (1) < attack runs (2); collect more benign runs"),
        ("INFO", "shape `s1` dominates 90% of windows; consider per-shape metrics or more diverse data"),
        ("INFO", "2 run(s) skipped (missing flight table; convert the capture first)"),
        ("INFO", "1 run(s) skipped (missing/unreadable metadata.json)"),
    ]


def test_warnings_empty_class_and_other_reasons(spark):
    rows = [(i, f"run_{i}", "attack", "s", 10, 5, False) for i in range(6)] + [(9, "run_9", "attack", "s", 0, 0, False), (10, "run_10", "attack", "s", 3, 0, True)]
    got = messages(audit.warnings(per_run(spark, rows)))
    assert got[0] == ("SEVERE", "benign class has 0 runs — cannot train")
    assert ("WARN", "1 run(s) have rows < window_size: run_10") in got
    assert ("WARN", "1 run(s) produce 0 windows for other reasons: run_9") in got
    many = [(i, f"run_{i}", "attack", "s", 1, 0, True) for i in range(7)]
    assert ("WARN", "7 run(s) have rows < window_size (produce 0 windows): run_0, run_1, run_2, run_3, run_4 …") in messages(audit.warnings(per_run(spark, many)))


def test_projected_split_is_half_even(spark):
    df = spark.createDataFrame([(3,), (12,), (13,), (50,)], "n int").select(*[c.alias(k) for k, c in audit.projected_split("n").items()])
    want = []
    for n in (3, 12, 13, 50):
        t = max(1, round(n * 0.2)); v = max(1, round((n - t) * 0.2)); want.append((n - t - v, v, t))
    assert [tuple(r) for r in df.collect()] == want


def test_usable_rows_modes(spark):
    df = spark.createDataFrame([(1, 1, "ATTITUDE", "null"), (2, 1, "ATTITUDE", "gps"), (2, 1, "ATTITUDE", "null"), (2, 1, "VFR_HUD", "gps")],
                               "run_id int, drone_id int, mav_packet_type string, attack_type string")
    runs = spark.createDataFrame([(1, "a", "benign"), (2, "b", "attack")], "run_id int, run_name string, run_label string")
    count = lambda mode: {r["run_id"]: r["n_rows"] for r in audit.usable_rows(df, runs, "ATTITUDE", mode).collect()}
    assert count("labelled") == {1: 1, 2: 1} and count("all") == {1: 1, 2: 2}


# --- splits ---------------------------------------------------------------
@pytest.mark.parametrize("benign,attack", [(3, 3), (3, 17), (10, 40)])
@pytest.mark.parametrize("seed", [1, 42])
def test_split_is_complete_disjoint_and_stratified(spark, benign, attack, seed):
    runs = spark.createDataFrame([(f"b{i}", "benign") for i in range(benign)] + [(f"a{i}", "attack") for i in range(attack)], "run_name string, run_label string")
    out = splits.patch_quota(splits.three_way_split(runs, seed=seed))
    rows = out.collect()
    assert len(rows) == benign + attack == len({r["run_name"] for r in rows})
    assert splits.check_split(out).isEmpty()
    for part in ("train", "val", "test"):
        assert {r["run_label"] for r in rows if r["split"] == part} == {"benign", "attack"}
    again = {r["run_name"]: r["split"] for r in splits.patch_quota(splits.three_way_split(runs.repartition(3), seed=seed)).collect()}
    assert again == {r["run_name"]: r["split"] for r in rows}


def test_split_preconditions(spark):
    few = spark.createDataFrame([("b1", "benign"), ("a1", "attack"), ("a2", "attack"), ("a3", "attack")], "run_name string, run_label string")
    with pytest.raises(ValueError, match="benign"):
        splits.three_way_split(few)
    assert splits.three_way_split(few, allow_imbalanced=True).count() == 4
    with pytest.raises(ValueError, match="no class"):
        splits.check_split_inputs(few.withColumn("run_label", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="no runs"):
        splits.check_split_inputs(few.limit(0))


def test_quota_sizes():
    assert splits.held_out_quota({"benign": 3, "attack": 7}, 0.2) == {"benign": 1, "attack": 1}
    assert splits.held_out_quota({"attack": 7}, 0.2) == 2
    assert splits.held_out_quota({"benign": 1, "attack": 7}, 0.2) == 2


def test_overlap_is_reported(spark):
    bad = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "run_name string, split string")
    assert [tuple(r) for r in splits.check_split(bad).collect()] == [("a", "train/test")]


def test_undersample_and_weights(spark):
    df = spark.range(1000).select(F.lit(1).alias("run_id"), F.lit(1).alias("drone_id"), F.col("id").alias("window_index"), (F.col("id") < 30).cast("int").alias("y_true"))
    out = windows.undersample(df)
    assert {r["y_true"]: r["count"] for r in out.groupBy("y_true").count().collect()} == {0: 30, 1: 30}
    assert out.exceptAll(windows.undersample(df.repartition(5))).isEmpty()
    assert windows.undersample(df.filter("y_true = 0")).count() == 970
    w = {r["label"]: r["weight"] for r in windows.class_weights(df.filter("y_true = 1")).collect()}
    assert w == {0: 1.0, 1: 0.5}


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0, "benign"), (3.0, 5.0, "benign"), (100.0, 6.0, "attack")], "a double, b double, run_label string")
    stats = scaling.fit_scaler(df, ["a", "b"], "train_benign")
    row = stats.first()
    assert row["mean"] == [2.0, 5.0] and row["scale"] == [1.0, 1.0]
    assert [r["a"] for r in scaling.apply_scaler(df, stats, ["a", "b"]).collect()] == [-1.0, 1.0, 98.0]


def test_sets(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "drone_id int")
    out = lambda df: sorted(r[0] for r in df.collect())
    assert out(sets.skipped(ids(1, 2, 3), ids(2))) == [1, 3]
    assert out(sets.effective_targets(ids(1, 2), ids(2, 9))) == [2] and out(sets.effective_targets(ids(1, 2))) == [1, 2]


def test_causal_windows_count_matches_formula(spark):
    rows = [(1, d, i * 1000, i, "benign", "null") for d, n in ((1, 3), (2, 8), (3, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id int, drone_id int, timestamp long, seq long, run_label string, attack_type string")
    got = {r["drone_id"]: r["count"] for r in windows.causal_windows(windows.training_rows(df), 8, 3).groupBy("drone_id").count().collect()}
    assert got == {2: 1, 3: 6}
    tensors = windows.window_tensors(df, ["seq"], 8, 3).filter("drone_id = 3").orderBy("window_index").collect()
    assert [t["tensor"][0][0] for t in tensors] == [0, 3, 6, 9, 12, 15] and all(len(t["tensor"]) == 8 for t in tensors)
    small = windows.causal_windows(df, 8, 3, target_rows=10).exceptAll(windows.causal_windows(df, 8, 3))
    assert small.isEmpty()


def test_labels_of_windows_of_any_length(spark):
    from skytrace.operators.labeling import label_rows, window_lookup

    day, year = 86_400.0, 365 * 86_400.0
    wins = [(0, 5 * day, 5 * day + 2.5, [1], "short"), (1, 0.0, 10 * year, [1, 2], "decade"), (2, 4 * day, 6 * day, [1, 2], "days"), (3, 9.0, 3.0, [1], "backwards")]
    windows = spark.createDataFrame(wins, "window_idx int, start_epoch double, end_epoch double, target_drones array<int>, attack_type string")
    assert window_lookup(windows, bucket_s=1.0).count() <= 3 * 5
    times = [-1.0, 0.0, 5 * day, 5 * day + 2.5, 5 * day + 2.6, 6 * day, 10 * year, 10 * year + 0.1, None]
    rows = [(i, drone, t) for i, (drone, t) in enumerate((d, t) for d in (1, 2, 3, None) for t in times)]
    df = spark.createDataFrame(rows, "seq int, drone_id int, frame_timestamp double")
    for bucket in (1.0, 3600.0):
        got = {r["seq"]: r["attack_type"] for r in label_rows(df, windows, bucket_s=bucket).collect()}
        assert len(got) == len(rows)
        for seq, drone, t in rows:
            want = [w[4] for w in wins if t is not None and w[1] <= t <= w[2] and drone in w[3]]
            assert got[seq] == (want[0] if want else None)
    assert label_rows(df, windows.limit(0)).filter("attack_type IS NOT NULL").isEmpty()


@pytest.mark.parametrize(("size", "stride", "target", "batch"), [(5, 1, 10**6, 10_000), (5, 3, 40, 7), (1, 2, 10**6, 3), (60, 5, 80, 11)])
def test_tensors_are_the_rows_of_their_windows(spark, size, stride, target, batch):
    from skytrace.operators import windows

    rows = [(1, d, t * 61_000, t, None if t % 4 == 0 else float(t), float(-t)) for d, n in ((1, 150), (None, 70), (3, 4)) for t in range(n)]
    df = spark.createDataFrame(rows, "run_id int, drone_id int, timestamp long, seq long, a double, b double").repartition(3)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = windows.window_tensors(df, ["a", "b"], size, stride, keep=["seq"], target_rows=target).collect()
    finally:
        spark.conf.set(name, before)
    want = {}
    for d, n in ((1, 150), (None, 70), (3, 4)):
        for k, first in enumerate(range(0, n - size + 1, stride)):
            want[d, k] = (first + size - 1, [[None if t % 4 == 0 else float(t), float(-t)] for t in range(first, first + size)])
    assert len(got) == len(want)
    assert {(r["drone_id"], r["window_index"]): (r["seq"], r["tensor"]) for r in got} == want
