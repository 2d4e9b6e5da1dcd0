"""Streams in several batches against the batch operators, and the pose filter."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skytrace.operators import state, windows
from skytrace.operators.labeling import label_rows
from skytrace.streaming import live

SCHEMA = ("seq long, link int, sysid int, drone_id int, run_id int, mav_packet_type string, timestamp long, frame_timestamp double, "
          "ts timestamp, type int, base_mode int, roll double, yaw double, heading double, throttle double, lat double, lon double, alt double, "
          "relative_alt double, fix_type int, voltage_battery int, current_battery int, battery_remaining int, y_true int")


def message(seq, sysid, kind, **cols):
    t = 1_700_000_000_000 + seq * 40
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")])
    row |= {"seq": seq, "link": 1, "sysid": sysid, "drone_id": sysid, "run_id": 1, "mav_packet_type": kind, "timestamp": t,
            "frame_timestamp": t / 1000.0, "ts": pd.Timestamp(t, unit="ms").to_pydatetime(), "y_true": seq % 2, **cols}
    return tuple(row.values())


@pytest.fixture(scope="module")
def flight(spark):
    rows = [
        message(0, 9, "ATTITUDE", roll=0.1, yaw=-0.5), message(1, 1, "ATTITUDE", roll=0.2, yaw=1.0),
        message(2, 9, "HEARTBEAT", type=6, base_mode=0), message(3, 9, "ATTITUDE", roll=0.3, yaw=0.1),
        message(4, 1, "HEARTBEAT", type=2, base_mode=209), message(5, 2, "HEARTBEAT", type=2, base_mode=81),
        message(6, 2, "ATTITUDE", roll=0.4, yaw=0.2), message(7, 1, "ATTITUDE", roll=0.5, yaw=2.0),
        message(8, 1, "VFR_HUD", heading=-10.0, throttle=140.0), message(9, 1, "ATTITUDE", roll=None, yaw=3.0),
        message(10, 1, "GLOBAL_POSITION_INT", lat=473977418.0, lon=85455939.0, alt=488000.0, relative_alt=1500.0),
        message(11, 1, "GPS_RAW_INT", fix_type=1), message(12, 1, "SYS_STATUS", voltage_battery=12600, current_battery=-1, battery_remaining=255),
        message(13, 1, "GPS_RAW_INT", fix_type=3), message(14, 1, "BAD_DATA", roll=9.9),
    ] + [message(15 + i, 1, "ATTITUDE", roll=float(i), yaw=0.0) for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture()
def stream(spark, flight, tmp_path):
    """The flight in four files, one per micro-batch, in time order."""
    src = tmp_path / "in"
    for i, (lo, hi) in enumerate(((0, 5), (5, 12), (12, 25), (25, 99))):
        flight.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.parquet(str(src / f"part={i}"))
    return spark.readStream.schema(flight.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(src))


def run(sdf, tmp_path, mode="append"):
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    if mode == "append":
        q = sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        q = sdf.writeStream.format("memory").queryName("board").option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(out) if mode == "append" else sdf.sparkSession.table("board")


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_gauges_asof(flight):
    rows = {r["seq"]: r for r in state.gauges_asof(flight).filter("sysid = 1").collect()}
    assert 14 not in rows
    assert math.isclose(rows[1]["heading_deg"], math.degrees(1.0)) and math.isclose(rows[7]["heading_deg"], math.degrees(1.0))
    assert rows[9]["heading_deg"] == 350.0 and rows[9]["throttle_pct"] == 100.0
    assert math.isclose(rows[9]["roll_deg"], math.degrees(0.5)) and rows[7]["armed"] is True
    assert math.isclose(rows[10]["lat"], 47.3977418) and rows[10]["alt_rel_m"] == 1.5
    assert rows[11]["lat"] is None and rows[11]["gps_fix_name"] == "GPS_FIX_TYPE_NO_FIX" and math.isclose(rows[13]["lat"], 47.3977418)
    assert rows[12]["batt_voltage_v"] == 12.6 and rows[12]["batt_current_a"] is None and rows[12]["batt_remaining_pct"] is None


def test_gauges_stream_equals_latest(stream, flight, tmp_path):
    board = run(live.gauges_stream(stream), tmp_path, "complete").drop("packets_received")
    assert same(board, state.latest_gauges(flight).select(*board.columns))


def test_lock_stream_equals_batch(stream, flight, tmp_path):
    got = run(live.lock_stream(stream), tmp_path).select("seq")
    want = state.lock_vehicle(flight).select("seq")
    assert same(got, want)
    assert [r[0] for r in want.orderBy("seq").limit(5).collect()] == [0, 1, 4, 7, 8]


def test_label_stream_equals_batch(stream, flight, tmp_path, spark):
    t0 = 1_700_000_000.0
    wins = spark.createDataFrame([(0, t0 + 0.1, t0 + 0.4, [1, 2], "gps_spoof")], "window_idx int, start_epoch double, end_epoch double, target_drones array<int>, attack_type string")
    q = live.stream_capture(stream, wins, str(tmp_path / "out"), str(tmp_path / "marks"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("seq", "attack_type")
    want = label_rows(flight.filter("mav_packet_type <> 'BAD_DATA'"), wins).select("seq", F.coalesce("attack_type", F.lit("null")).alias("attack_type"))
    assert same(got, want) and want.filter("attack_type = 'gps_spoof'").count() > 3


def test_capture_files_follow_rows_not_drones(spark, tmp_path):
    rows = [message(i, i % 150, "ATTITUDE", roll=float(i)) for i in range(600)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    wins = spark.createDataFrame([], "window_idx int, start_epoch double, end_epoch double, target_drones array<int>, attack_type string")
    for name, folders in (("flat", False), ("folders", True)):
        out = tmp_path / name
        live.stream_capture(stream, wins, str(out), str(tmp_path / f"marks-{name}"), folders=folders).awaitTermination()
        files = list(out.rglob("part-*.parquet"))
        assert len(files) == 150 if folders else len(files) <= 8  # a file a task, not one for each of its drones
        got = spark.read.parquet(str(out))
        assert sorted(map(tuple, got.select("drone_id", "seq").collect())) == sorted((i % 150, i) for i in range(600))


def test_window_stream_equals_batch(stream, flight, tmp_path):
    att = lambda df: df.filter("mav_packet_type = 'ATTITUDE' and roll is not null")
    cols = ["run_id", "drone_id", "window_index", "row_start_index", "row_end_index", "window_start_timestamp", "window_end_timestamp", "y_true"]
    got = run(live.window_stream(att(stream), ["roll"], 8, 3), tmp_path)
    want = windows.causal_windows(att(flight), 8, 3, keep=["y_true"])
    assert same(got.select(*cols), want.select(*cols))
    tensors = windows.window_tensors(att(flight), ["roll"], 8, 3)
    pairs = lambda df: {(r["drone_id"], r["window_index"]): r["tensor"] for r in df.collect()}
    assert pairs(got) == pairs(tensors)


def test_throttle_keeps_the_last_of_each_period(stream, flight, tmp_path):
    got = run(live.throttle(stream.select("sysid", "ts", "seq"), "100 milliseconds", delay="0 seconds"), tmp_path)
    slots = flight.groupBy(F.window("ts", "100 milliseconds").alias("w"), "sysid").agg(F.max("seq").alias("seq"))
    last = slots.select(F.col("w.end").alias("emit_at"), "sysid", "seq")
    closed = last.filter(F.col("emit_at") <= F.lit(flight.agg(F.max("ts")).first()[0]))
    assert same(got.select("emit_at", "sysid", "seq"), closed)


def test_ticking_repeats_without_new_messages(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", "1").load().selectExpr("1 as sysid", "timestamp as ts", "value")
    q = live.ticking(rate, 100).writeStream.format("memory").queryName("ticks").outputMode("append").trigger(processingTime="200 milliseconds").start()
    import time

    end = time.time() + 60
    while time.time() < end and (spark.table("ticks").isEmpty() or spark.sql("select max(n) from (select count(*) n from ticks group by value)").first()[0] < 2):
        time.sleep(0.5)
    q.stop()
    assert spark.sql("select max(n) from (select count(*) n from ticks group by value)").first()[0] >= 2


def test_ticking_keeps_the_rate_and_forgets_silent_systems(spark, tmp_path):
    import time

    rows = [(1, pd.Timestamp(i, unit="s").to_pydatetime(), i) for i in range(5)] + [(2, pd.Timestamp(9, unit="s").to_pydatetime(), 9)]
    spark.createDataFrame(rows, "sysid int, ts timestamp, value long").coalesce(1).write.parquet(str(tmp_path / "in"))
    sdf = spark.readStream.schema("sysid int, ts timestamp, value long").parquet(str(tmp_path / "in"))
    q = live.ticking(sdf, 300, silent_ms=12_000).writeStream.format("memory").queryName("rated").outputMode("append").trigger(processingTime="100 milliseconds").start()
    end, last, still = time.time() + 120, -1, 0
    while time.time() < end and still < 20:  # until nothing comes for a while
        time.sleep(0.5)
        n = spark.table("rated").count()
        still, last = (still + 1, n) if n and n == last else (0, n)
    q.stop()
    got = spark.table("rated").toPandas()
    assert still >= 20 and set(zip(got.sysid, got.value)) == {(1, 4), (2, 9)}
    for _, part in got.groupby("sysid"):
        times = np.sort(part.emitted_ms.to_numpy())
        assert len(times) >= 2 and np.diff(times).min() >= 300


def test_window_stream_over_many_batches(spark, tmp_path):
    rows = [(1, 1, float(i), i, i % 2, float(i), float(-i)) for i in range(157)]
    schema = "run_id int, drone_id int, timestamp double, seq long, y_true int, a double, b double"
    rng, at, i = np.random.default_rng(2), 0, 0
    while at < len(rows):
        n = int(rng.integers(1, 25))
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={i:02}"))
        at, i = at + n, i + 1
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = {r["window_index"]: r for r in run(live.window_stream(sdf, ["a", "b"], 10, 4), tmp_path).collect()}
    assert sorted(got) == list(range((157 - 10) // 4 + 1))
    for k, r in got.items():
        assert r["tensor"] == [[float(v), float(-v)] for v in range(4 * k, 4 * k + 10)]
        assert (r["row_start_index"], r["row_end_index"], r["window_end_timestamp"], r["y_true"]) == (4 * k, 4 * k + 10, 4 * k + 9.0, (4 * k + 9) % 2)


def test_rate_board_and_dedup(stream, flight, tmp_path):
    got = run(live.dedup_logs(stream.selectExpr("sysid as id", "ts")), tmp_path)
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 9]
    board = live.rate_board(flight, "1 second")
    assert board.agg(F.sum("messages")).first()[0] == flight.count()


def test_identity(flight):
    assert {r["sysid"]: r["vehicle_type"] for r in state.vehicle_identity(flight, ["sysid"]).collect()} == {1: 2, 2: 2}
    assert state.vehicle_identity(flight).first()["vehicle_type"] == 2
    newest = state.latest_per_type(flight, ["sysid"], cols=["roll"]).filter("sysid = 1 and mav_packet_type = 'ATTITUDE'").first()
    assert newest["seq"] == 44 and newest["roll"] == 29.0


# --- pose filter ----------------------------------------------------------
def brute(poses):
    """Sequential definition with rotation matrices instead of quaternion products."""
    last, out = {}, []
    for name, seq, t, p, angle in poses:
        if name not in last:
            last[name] = (t, p, angle)
            continue
        t0, p0, a0 = last[name]
        early = 0 < t - t0 < 0.03
        moved = sum((a - b) ** 2 for a, b in zip(p, p0)) > 1e-4
        turned = math.sin((angle - a0) / 2) ** 2 > 1e-4
        if not early and (moved or turned):
            last[name] = (t, p, angle)
            out.append((name, seq))
    return sorted(out)


@pytest.fixture(scope="module")
def pose_list():
    rng = np.random.default_rng(5)
    out = []
    clock = {}
    for seq in range(6000):
        name = "hot" if rng.random() < 0.7 else f"e{rng.integers(0, 5)}"
        clock[name] = 0.0 if seq == 3000 else clock.get(name, 0.0) + float(rng.choice([0.0, 0.01, 0.02, 0.05]))
        p = tuple(float(v) for v in rng.integers(0, 3, 3) * 0.006)
        out.append((name, seq, clock[name], p, float(rng.integers(0, 3)) * 0.015))
    return out


def frame(spark, poses):
    rows = [(n, s, t, *p, math.cos(a / 2), 0.0, 0.0, math.sin(a / 2)) for n, s, t, p, a in poses]
    return spark.createDataFrame(rows, "name string, seq long, time double, x double, y double, z double, qw double, qx double, qy double, qz double")


@pytest.mark.parametrize("target", [1000, 10**6])
def test_dead_band(spark, pose_list, target):
    got = state.dead_band(frame(spark, pose_list), target_rows=target)
    assert sorted((r["name"], r["seq"]) for r in got.collect()) == brute(pose_list)


def test_dead_band_with_shifting_pieces(spark):
    # steady slow drift: where poses pass depends on the start, piece after piece
    poses = [("hot", s, s * 0.01, (s * 0.0023, 0.0, 0.0), 0.0) for s in range(20_000)]
    got = state.dead_band(frame(spark, poses), target_rows=1000)
    assert sorted((r["name"], r["seq"]) for r in got.collect()) == brute(poses)


def test_gate_equals_single_steps():
    rng = np.random.default_rng(1)
    poses = np.column_stack([np.cumsum(rng.choice([0.0, 0.01, 0.05, -0.2], 900, p=[0.3, 0.4, 0.29, 0.01])), rng.integers(0, 3, (900, 3)) * 0.006, rng.choice([0.0, 1.0, 0.9], (900, 1)), np.zeros((900, 2)), rng.choice([0.0, 0.02], (900, 1))])
    poses[300:500, 1:] = poses[300, 1:]  # a long rest
    gate = state.PoseGate(0.03, 1e-4, 1e-4)
    for begin in (None, poses[7]):
        kept, last = gate.scan(poses, begin)
        now, want = begin, []
        for p in poses:
            ok = now is not None and bool(gate.passes(now, p[None])[0])
            now = p if now is None or ok else now
            want.append(ok)
        assert kept.tolist() == want and last.tolist() == now.tolist()


def test_dead_band_stream(spark, pose_list, tmp_path):
    df = frame(spark, pose_list)
    for i in range(3):
        df.filter(F.col("seq").between(i * 2000, i * 2000 + 1999)).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    sdf = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(live.dead_band_stream(sdf), tmp_path)
    assert sorted((r["name"], r["seq"]) for r in got.collect()) == brute(pose_list)
