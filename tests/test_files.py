"""File sources and sinks on small hand-made trees."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from skytrace.sources import cache, capture, logs, metadata, table_log


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture()
def tree(tmp_path):
    head = "mav_packet_type,timestamp,roll,attack_type\n"
    put(tmp_path / "all/run_1_none_n2_s1_e2/csv/drone_001.csv", head + "ATTITUDE,20,0.5,null\nATTITUDE,3,0.7,null\nVFR_HUD,5,null,null\n")
    put(tmp_path / "all/run_1_none_n2_s1_e2/csv/drone_012.csv", head + "ATTITUDE,9,x,null\n")
    put(tmp_path / "all/deep/run_2_gps_spoof_n1_s1_e2/csv/drone_003.csv", head + "ATTITUDE,7,1.0,gps_spoof\n")
    put(tmp_path / "all/run_1_none_n2_s1_e2/metadata.json", json.dumps({"attack": "none", "swarm_size": 2, "ready_drones": [1, 12], "row_counts": {"ATTITUDE": 3}}, indent=2))
    put(tmp_path / "all/deep/run_2_gps_spoof_n1_s1_e2/metadata.json", "{broken")
    return str(tmp_path / "all")


def test_capture_scan(spark, tree):
    rows = capture.read_capture(spark, tree)
    assert rows.count() == 5 and dict(rows.dtypes)["timestamp"] == "string"
    assert {(r["run_name"], r["drone_id"]) for r in rows.collect()} == {
        ("run_1_none_n2_s1_e2", 1), ("run_1_none_n2_s1_e2", 12), ("run_2_gps_spoof_n1_s1_e2", 3)}
    assert rows.filter("roll = 'null'").count() == 1


def test_written_drones_make_one_file_each(spark, tmp_path):
    rows = [("run_1_none", i % 40, str(i), None if i % 7 else "1") for i in range(400)] + [("run_2_none", 3, str(i), "2") for i in range(400)]
    df = spark.createDataFrame(rows, "run_name string, drone_id int, timestamp string, roll string").repartition(6)
    for target, least, most in ((1000, 1, 1), (100, 2, 4)):  # a busy drone is dealt into several files, the others never
        root = tmp_path / f"by{target}"
        capture.write_capture(df, str(root), target_rows=target)
        files = lambda drone: len(list(root.glob(f"capture={drone}/part-*.csv")))
        assert all(files(f"run_1_none/file=drone_{d:03}.csv") == 1 for d in range(40))
        assert least <= files("run_2_none/file=drone_003.csv") <= most
        got = capture.read_capture(spark, str(root)).select("run_name", "drone_id", "timestamp", "roll").collect()
        assert sorted(map(tuple, got)) == sorted((r, d, t, v or "null") for r, d, t, v in rows)


def test_a_job_meets_few_files(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader as Reader, DataFrameWriter as Writer

    from skytrace.session import shared_dir

    rows = [(f"run_{i % 2}_none", i % 45, str(i), "ATTITUDE", None if i % 7 else f"{i % 10}") for i in range(900)] + [("run_2_none", 3, str(i), "ATTITUDE", "2") for i in range(200)]
    df = spark.createDataFrame(rows, "run_name string, drone_id int, timestamp string, mav_packet_type string, roll string").repartition(6)
    root, out, met = tmp_path / "in", str(tmp_path / "flight"), {"read": [], "written": []}
    files = lambda: len(list(root.glob("capture=*/file=*/part-*.csv")))
    for kind in ("text", "load"):
        own = getattr(Reader, kind)

        def read(self, *a, _own=own, **b):
            got = _own(self, *a, **b)
            met["read"].append(len(got.inputFiles()))
            return got

        monkeypatch.setattr(Reader, kind, read)
    own_csv = Writer.csv

    def written(self, *a, **b):
        before = files()
        own_csv(self, *a, **b)
        met["written"].append(files() - before)

    monkeypatch.setattr(Writer, "csv", written)
    monkeypatch.setattr(capture, "FILES_A_JOB", 30, raising=False)
    stale = root / "capture=run_9_none/file=drone_001.csv"
    put(stale / "part-0.csv", "timestamp\n1\n")  # what was there goes, as with a single job
    capture.write_capture(df, str(root), target_rows=100)
    assert not stale.exists() and 91 <= files() <= 93 and max(met["written"]) < 45
    want = sorted((r, d, t, v or "null") for r, d, t, _, v in rows)
    got = lambda table: sorted(map(tuple, table.select("run_name", "drone_id", "timestamp", "roll").collect()))
    assert got(capture.read_capture(spark, str(root))) == want
    assert {tuple(r) for r in capture.discover_runs(spark, str(root)).collect()} == {("run_0_none", 45), ("run_1_none", 45), ("run_2_none", 1)}
    said = capture.convert_all(spark, str(root), out)
    assert {tuple(r) for r in said.collect()} == {(f"run_{i}_none", "built") for i in range(3)}
    assert got(capture.read_flight(spark, out)) == want
    assert max(met["read"]) <= 33  # 30 drones, one of them in up to three files
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "4m")  # as large as a small file counts else
    try:
        assert len(capture.landed(spark, str(root)).inputFiles()) <= 4 * 12
    finally:
        spark.conf.set(size, before)
    assert not [name for name in os.listdir(shared_dir(spark).removeprefix("file:")) if name.startswith("dealt-")]


def test_batches_hold_each_file_once(spark, tree, tmp_path, monkeypatch):
    put(tmp_path / "all/run_5_[x]_*/drone_001.csv/part-0.csv", "timestamp\n1\n")  # a name, not a pattern
    for hidden in ("_temporary/run_6/drone_001.csv", ".trash/run_6/drone_001.csv", "run_7/drone_002.csv._COPYING_"):
        put(tmp_path / "all" / hidden, "timestamp\n1\n")
    put(tmp_path / "all/_part=1/run_8/drone_001.csv", "timestamp\n1\n")
    roots = [tree, f"{tree}/deep", f"{tree}/run_*"]
    read = lambda: sorted(map(str, capture.landed(spark, roots).drop("_at").collect()))
    whole = read()
    assert len(whole) == 12
    monkeypatch.setattr(capture, "FILES_A_JOB", 2)
    assert [len(b) for b in capture._batches(spark, roots)] == [2, 2, 2, 1] and read() == whole
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        capture.landed(spark, [f"{tree}/none"])


def test_files_unite_by_name(spark, tmp_path):
    put(tmp_path / "run_1/csv/drone_001.csv", "a,b\n1,2\n")
    put(tmp_path / "run_1/csv/drone_002.csv", 'b,c,a\n2,"x,y",1\n')
    put(tmp_path / "run_1/csv/notes.csv", "a\n9\n")
    rows = capture.read_capture(spark, str(tmp_path)).collect()
    assert {(r["drone_id"], r["a"], r["b"], r["c"]) for r in rows} == {(1, "1", "2", None), (2, "1", "2", "x,y")}


def test_later_import_keeps_all_columns(spark, tmp_path):
    out, schema = str(tmp_path / "flight"), "run_name string, mav_packet_type string, drone_id int, timestamp string"
    capture.to_flight(spark.createDataFrame([("run_1", "A", 1, "1", "5")], schema + ", roll string"), out)
    capture.to_flight(spark.createDataFrame([("run_2", "A", 1, "1", "7")], schema + ", groundspeed string"), out)
    got = {(r["run_name"], r["roll"], r["groundspeed"]) for r in capture.read_flight(spark, out).collect()}
    assert got == {("run_1", "5", None), ("run_2", None, "7")}


def test_rows_without_run_are_built_once(spark, tmp_path):
    out = str(tmp_path / "flight")
    df = spark.createDataFrame([(None, "A", 1, "1")], "run_name string, mav_packet_type string, drone_id int, timestamp string")
    assert [tuple(r) for r in capture.to_flight(df, out).collect()] == [(None, "built")]
    assert [tuple(r) for r in capture.to_flight(df, out).collect()] == [(None, "skipped")]
    assert capture.read_flight(spark, out).count() == 1


def test_broken_run_stops_no_other(spark, tmp_path):
    for run in ("run_1_a", "run_2_a", "run_3_a"):
        put(tmp_path / f"in/{run}/csv/drone_001.csv", "timestamp,mav_packet_type\n1,ATTITUDE\n")
    (tmp_path / "in/run_2_a/csv/.drone_001.csv.crc").write_bytes(b"crc\x00\x00\x00\x02\x00\x00\x00\x00\x07")  # its checksum is wrong
    said = capture.convert_all(spark, str(tmp_path / "in"), str(tmp_path / "flight"))
    assert {tuple(r) for r in said.collect()} == {("run_1_a", "built"), ("run_2_a", "failed"), ("run_3_a", "built")}
    assert capture.read_flight(spark, str(tmp_path / "flight")).count() == 2


def test_conversion_scans_the_text_once(spark, tree, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader as Reader

    opened = []
    for kind in ("text", "csv"):
        own = getattr(Reader, kind)
        monkeypatch.setattr(Reader, kind, lambda self, *a, _own=own, _kind=kind, **b: opened.append((_kind, a)) or _own(self, *a, **b))
    out, landed = str(tmp_path / "flight"), []
    own_landed = capture.landed
    monkeypatch.setattr(capture, "landed", lambda *a: landed.append(own_landed(*a)) or landed[-1])
    capture.convert_all(spark, tree, out).collect()
    assert [k for k, _ in opened] == ["text"]
    # the landed lines are gone, as nothing needs them after the write
    assert not any(os.path.exists(name.removeprefix("file:").replace("///", "/")) for name in landed[0].inputFiles())
    capture.convert_all(spark, tree, out).collect()
    assert len(opened) == 1  # built runs are not read again
    plan = capture.read_flight(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan text" not in plan


def test_table_log(spark, tmp_path):
    out, schema = str(tmp_path / "flight"), "run_name string, mav_packet_type string, drone_id int, timestamp string"
    capture.to_flight(spark.createDataFrame([("run_1", "A", 1, "1", "5")], schema + ", roll string"), out)
    capture.to_flight(spark.createDataFrame([("run_2", "A", 1, "1", "7")], schema + ", groundspeed string"), out)
    log = table_log.TableLog(spark, out)
    assert [v["rows"] for v in log.versions()] == [1, 1]
    assert list(log.columns()) == ["run_name", "mav_packet_type", "drone_id", "timestamp", "roll", "groundspeed"]
    with pytest.raises(table_log.ColumnConflict, match="roll: string, now double"):
        capture.to_flight(spark.createDataFrame([("run_3", "A", 1, "1", 0.5)], schema + ", roll double"), out)
    assert capture.read_flight(spark, out).count() == 2 and len(log.versions()) == 2
    # two writers that saw the same version: both are kept
    one, two = table_log.TableLog(spark, out), table_log.TableLog(spark, out)
    seen = one.versions()
    two.versions = one.versions = lambda: seen
    assert (one.commit(log.schema(), 0), two.commit(log.schema(), 0)) == (2, 3)
    assert len(log.versions()) == 4
    # a table without a log still has all columns
    spark.createDataFrame([("r", "A", "1")], "run_name string, mav_packet_type string, a string").write.partitionBy("run_name", "mav_packet_type").parquet(str(tmp_path / "old"))
    assert capture.read_flight(spark, str(tmp_path / "old")).columns == ["a", "run_name", "mav_packet_type"]


def test_innermost_run_folder(spark):
    df = spark.createDataFrame([("file:/data/run_archive/run_3_x/csv/drone_001.csv",)], "p string")
    assert df.select(capture.run_of("p")).first()[0] == "run_3_x"


def test_flight_table_and_skipping(spark, tree, tmp_path):
    out = str(tmp_path / "flight")
    first = capture.convert_all(spark, tree, out)
    assert {r["status"] for r in first.collect()} == {"built"}
    assert {r["status"] for r in capture.convert_all(spark, tree, out).collect()} == {"skipped"}
    table = capture.read_flight(spark, out)
    assert table.count() == 5
    assert {r["status"] for r in capture.convert_all(spark, tree, out, force=True).collect()} == {"built"}
    assert capture.read_flight(spark, out).count() == 5
    rows = capture.read_primary(capture.read_flight(spark, out), "ATTITUDE", ["roll"], run="run_1_none_n2_s1_e2")
    assert sorted((r["timestamp"], r["roll"]) for r in rows.collect()) == [(3.0, 0.7), (9.0, None), (20.0, 0.5)]
    assert "filename" in capture.read_primary(capture.read_flight(spark, out), "ATTITUDE", ["absent"]).columns
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pruned, pushed = plan.split("PartitionFilters: [")[1].split("PushedFilters:")
    assert "ATTITUDE" in pruned and pushed.strip().startswith("[]")


def test_discovery_and_metadata(spark, tree):
    found = capture.discover_runs(spark, tree)
    assert {r["run_name"]: r["drones"] for r in found.collect()} == {"run_1_none_n2_s1_e2": 2, "run_2_gps_spoof_n1_s1_e2": 1}
    assert capture.discover_runs(spark, tree, ["run_1_none_n2_s1_e2"]).count() == 1
    good, bad = metadata.read_metadata(spark, tree)
    row = good.first()
    assert good.count() == 1 and row["attack"] == "none" and row["row_counts"] == {"ATTITUDE": 3} and row["ready_drones"] == [1, 12]
    assert [r["run_name"] for r in bad.collect()] == ["run_2_gps_spoof_n1_s1_e2"]
    left = metadata.skipped_runs(found, good, good.limit(0))
    assert {tuple(r) for r in left.collect()} == {("run_2_gps_spoof_n1_s1_e2", "metadata"), ("run_1_none_n2_s1_e2", "flight")}


@pytest.fixture()
def legacy(tmp_path):
    root = tmp_path / "nominal_data"
    put(root / "Nominal-4/Nominal-4-1/ATTITUDE.csv", "mav_packet_type,timestamp,roll\nATTITUDE,1,0.5\nATTITUDE,2,0.6\n")
    put(root / "Nominal-4/Nominal-4-1/VFR_HUD.csv", "timestamp,mav_packet_type,alt\n3,VFR_HUD,9\n")
    put(root / "Nominal-4/Nominal-4-20/ATTITUDE.csv", "mav_packet_type,timestamp,roll\nATTITUDE,1,0.1\n")
    put(root / "legacy-nominal-5/x-5-2/ATTITUDE.csv", "mav_packet_type,timestamp,roll\nATTITUDE,1,0.1\n")
    put(root / "other/x-1/ATTITUDE.csv", "mav_packet_type,timestamp,roll\nATTITUDE,1,0.1\n")
    put(tmp_path / "attack_data/GPS-spoof/Run-7/Run-7-3/ATTITUDE.csv", "mav_packet_type,timestamp,attack_type\nATTITUDE,1,old\n")
    return tmp_path


def test_legacy_union_by_name(spark, legacy):
    rows = capture.read_legacy_run(spark, str(legacy / "nominal_data/Nominal-4"))
    got = {(r["drone_id"], r["mav_packet_type"], r["timestamp"], r["roll"], r["alt"]) for r in rows.collect()}
    assert got == {(1, "ATTITUDE", "1", "0.5", None), (1, "ATTITUDE", "2", "0.6", None), (1, "VFR_HUD", "3", None, "9"), (20, "ATTITUDE", "1", "0.1", None)}


def test_legacy_discovery(spark, legacy):
    benign = capture.discover_legacy(spark, str(legacy / "nominal_data"), "benign")
    assert {r["run_name"] for r in benign.collect()} == {"run_legacy-nominal-4_none_legacy", "run_legacy-nominal-5_none_legacy"}
    attack = capture.discover_legacy(spark, str(legacy / "attack_data"), "attack").first()
    assert tuple(attack) == ("Run-7", "GPS-spoof", "run_legacy-gpsspoof-7_gps_spoof_legacy")
    assert capture.discover_legacy(spark, str(legacy / "attack_data"), "attack", ["attitude-spoof"]).isEmpty()


def test_legacy_import(spark, legacy):
    out = str(legacy / "flight")
    checks = capture.import_legacy(spark, str(legacy / "nominal_data"), "benign", out).unionByName(
        capture.import_legacy(spark, str(legacy / "attack_data"), "attack", out))
    got = {r["run_name"]: (r["src_rows"], r["drones"], r["violations"]) for r in checks.collect()}
    assert got == {"run_legacy-nominal-4_none_legacy": (4, 2, []), "run_legacy-nominal-5_none_legacy": (1, 1, []), "run_legacy-gpsspoof-7_gps_spoof_legacy": (1, 1, [])}
    labels = {r["attack_type"] for r in capture.read_flight(spark, out).filter("run_name like '%gps%'").collect()}
    assert labels == {"gps_spoof"}


def test_import_violations(spark):
    src = spark.createDataFrame([("r", 1), ("r", 2)], "run_name string, drone_id int")
    dst = spark.createDataFrame([("r", None, "x"), ("r", 1, "null"), ("r", 1, "null")], "run_name string, drone_id int, attack_type string")
    row = capture.verify_import(src, dst, F.lit("null")).first()
    assert row["violations"] == ["row count", "drone count", "missing drone", "label"]


def test_train_log(spark, tmp_path):
    text = ("   Benign  0.99 0.99 0.99 50\n   Attack       0.9100    0.8800    0.8900      1234\nOptimal threshold (from val) : 0.4321\n"
            "   Attack  0.5 0.25 0.33 10  \n Attack 0.1 0.1\n")
    put(tmp_path / "logs/1layer_w80_s2.log", text)
    put(tmp_path / "logs/2layer_w80_s2.log", "nothing here\n")
    rows = {r["tag"]: r for r in logs.parse_train_logs(spark, str(tmp_path / "logs")).collect()}
    a = rows["1layer_w80_s2"]
    assert (a["val_attack_precision"], a["val_attack_f1"], a["val_attack_support"]) == (0.91, 0.89, 1234)
    assert (a["test_attack_recall"], a["test_attack_support"], a["best_threshold"]) == (0.25, 10, 0.4321)
    assert rows["2layer_w80_s2"]["val_attack_f1"] is None and rows["2layer_w80_s2"]["best_threshold"] is None


def test_stage_log_and_inventory(spark, tmp_path):
    put(tmp_path / "s.log", "[stage2 instance=7] step=arm elapsed=1.23s\nnoise\n[stage3 instance=7] step=mission_upload elapsed=10.00s\n")
    steps = logs.parse_stage_logs(spark, str(tmp_path / "s.log")).collect()
    assert [tuple(r) for r in steps] == [("stage2", 7, "arm", 1.23), ("stage3", 7, "mission_upload", 10.0)]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/00000002.BIN").write_bytes(b"x" * 1_048_576)
    (tmp_path / "bin/00000001.BIN").write_bytes(b"x" * 524_288)
    got = [(r["name"], r["size_mb"]) for r in logs.log_inventory(spark, str(tmp_path / "bin")).collect()]
    assert got == [("00000001.BIN", 0.5), ("00000002.BIN", 1.0), (None, 1.5)]


def test_fingerprint(spark, tree, tmp_path):
    files = cache.file_entries(spark, tree)
    key = lambda f, s: cache.fingerprint(f, s).first()[0]
    base = key(files, {"primary_type": "ATTITUDE"})
    assert len(base) == 16 and base == key(files.repartition(4), {"primary_type": "ATTITUDE"})
    assert base != key(files, {"primary_type": "VFR_HUD"}) and base != key(files.withColumn("size", F.col("size") + 1), {"primary_type": "ATTITUDE"})


def test_cache_rebuilds_unfinished_entries(spark, tmp_path):
    root, built = str(tmp_path), []

    def build():
        built.append(1)
        return spark.range(3).withColumn("split", F.lit("train"))

    assert cache.cached(spark, root, "k", build).count() == 3
    assert cache.cached(spark, root, "k", build).count() == 3 and len(built) == 1
    import shutil

    shutil.move(str(tmp_path / "k/manifest"), str(tmp_path / "gone"))
    assert cache.cached(spark, root, "k", build).count() == 3 and len(built) == 2
