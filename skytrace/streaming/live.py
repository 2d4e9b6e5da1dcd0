"""Structured Streaming forms of labelling, latest state, throttling and change filters.

State is bounded: event-time operators take a watermark delay, keyed operators hold one
record (or one window of rows) per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skytrace import fixed_values as fixed
from skytrace.functions import scalars as S
from skytrace.operators.labeling import BUCKET_S, label_rows
from skytrace.operators.state import GAUGES, POSE, PoseGate, gauge_readings, sanitize_gauges

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- ingest ---------------------------------------------------------------
def read_messages(spark: SparkSession, path: str, schema, format: str = "json", **options: str) -> DataFrame:
    """Messages as they land in a folder; other Spark sources give the same frame."""
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def label_stream(sdf: DataFrame, windows: DataFrame, time: str | Column = "frame_timestamp", by: list[str] = (), bucket_s: float = BUCKET_S) -> DataFrame:
    """Attack labels for arriving rows: the batch join, with the windows as static side."""
    return label_rows(sdf, windows, time, by, bucket_s)


def stream_capture(
    sdf: DataFrame, windows: DataFrame, out: str, checkpoint: str, by: list[str] = (), bucket_s: float = BUCKET_S, folders: bool = False, **trigger
) -> StreamingQuery:
    """Label good messages of known drones and append them, each batch's rows of a drone in one file where they aren't very many.

    The number of files follows the rows. With ``folders`` each drone gets a folder, to which a batch adds a file;
    that suits some thousand drones.
    """
    rows = S.good_data(sdf).filter(F.col("drone_id").isNotNull())
    labelled = label_stream(rows, windows, by=by, bucket_s=bucket_s).withColumns({
        "timestamp": S.to_millis("frame_timestamp"),
        "attack_type": F.coalesce("attack_type", F.lit(fixed.NULL_TEXT)),
    })
    # Adaptive execution splits the rows of a busy drone; without it they meet in one task.
    writer = labelled.hint("rebalance", F.col("drone_id")).writeStream
    return (
        (writer.partitionBy("drone_id") if folders else writer).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    )


# --- aggregates -----------------------------------------------------------
def _at(sdf: DataFrame, ts: str) -> Column:
    return F.struct(ts, "seq") if "seq" in sdf.columns else F.col(ts)


def gauges_stream(sdf: DataFrame, key: str = "sysid", ts: str = "ts") -> DataFrame:
    """Latest gauges per system (update or complete output). Earlier NULLs never overwrite; equal clocks go by ``seq``."""
    at = _at(sdf, ts)
    readings = gauge_readings(sdf)
    rows = S.good_data(sdf).select(key, at.alias("_at"), *[c.alias(n) for n, c in readings.items()])
    latest = rows.groupBy(key).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_at"))).alias(n) for n in readings],
        F.min_by("yaw_deg", F.when(F.col("yaw_deg").isNotNull(), F.col("_at"))).alias("_first_yaw"),
        F.count(F.lit(1)).alias("packets_received"),
    )
    full = latest.withColumns({
        "heading_deg": F.coalesce("hud_heading", "_first_yaw"), "gps_fix_name": S.fix_name("gps_fix_type"),
    })
    return sanitize_gauges(full.select(key, "packets_received", *GAUGES))


def throttle(sdf: DataFrame, period: str = fixed.EMIT_PERIOD, key: str = "sysid", ts: str = "ts", delay: str = "1 second") -> DataFrame:
    """At most one record per system and period: the last of each period.

    With append output a record comes once its period is over; with update output the open period's
    record comes too and is replaced as newer ones arrive, so the end of a feed is not held back.
    """
    cols = [c for c in sdf.columns if c not in (key, ts)]
    last = F.max_by(F.struct(*cols), _at(sdf, ts)).alias("last")
    grouped = sdf.withWatermark(ts, delay).groupBy(F.window(ts, period), key).agg(F.max(ts).alias(ts), last)
    return grouped.select(F.col("window.end").alias("emit_at"), key, ts, "last.*")


def rate_board(sdf: DataFrame, size: str = "10 seconds", delay: str = "10 seconds", by: list[str] = (), ts: str = "ts") -> DataFrame:
    """Messages per type in tumbling windows."""
    marked = sdf.withWatermark(ts, delay) if sdf.isStreaming else sdf
    counts = marked.groupBy(F.window(ts, size).alias("w"), *by, "mav_packet_type").agg(F.count(F.lit(1)).alias("messages"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "mav_packet_type", "messages")


def dedup_logs(sdf: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """First announcement of each archived log within the watermark."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["id"])


def vehicle_identity_stream(sdf: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """Vehicle type per link from heartbeats, quadrotor preferred (update output)."""
    beats = S.primary(sdf, "HEARTBEAT").filter(F.col("type") != fixed.MAV_TYPE_GCS)
    preferred = F.when(F.col("type") == fixed.MAV_TYPE_QUADROTOR, 0).otherwise(1)
    return beats.groupBy(*by).agg(F.min_by("type", F.struct(preferred, _at(sdf, ts))).alias("vehicle_type"))


# --- keyed state ----------------------------------------------------------
def _batch(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """Rows of one key in one micro-batch, in arrival order."""
    parts = list(frames)
    rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    return rows if rows.empty else rows.sort_values(order, kind="stable")


def _fields(sdf: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sdf.select(*names).schema)


def _stateful(sdf: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """State variables and timers need the RocksDB state store, which also writes only what changed."""
    sdf.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return sdf.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", time_mode)


def _plain(value):
    """A cell as the state store takes it."""
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


class _Ticker(StatefulProcessor):
    """Holds a system's last record; a timer per system emits it and sets the next one."""

    def __init__(self, period_ms: int, cols: list[str], held: str, names: list[str], order: list[str], silent_ms: int | None):
        self.period_ms, self.cols, self.held, self.names, self.order, self.silent_ms = period_ms, cols, held, names, order, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.held, self.silent_ms)
        self.due = handle.getValueState("due", "at long")

    def _emit(self, key, now: int) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([(*key, *self.last.get(), now)], columns=self.names)

    def _set(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = _batch(rows, self.order).iloc[-1]
        self.last.update(tuple(_plain(newest[c]) for c in self.cols))
        if not self.due.exists():  # the first record, or the first after a long silence
            now = timerValues.getCurrentProcessingTimeInMs()
            self._set(now + self.period_ms)
            yield from self._emit(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():  # outlived
            self.due.clear()
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self._set(now + self.period_ms)
        yield from self._emit(key, now)


def ticking(sdf: DataFrame, period_ms: int = 100, key: str = "sysid", order: list[str] = ("ts",), silent_ms: int | None = None) -> DataFrame:
    """Emit each system's last record every period, also while no message arrives, and never more often.

    A registered processing-time timer per system drives the emission; messages only replace the record. After ``silent_ms`` without
    one the record's time to live ends and so do its emissions, until the next message. ``emitted_ms`` is the
    processing time. Needs a trigger that keeps firing.
    """
    cols = [c for c in sdf.columns if c != key]
    ticker = _Ticker(period_ms, cols, _fields(sdf, cols), [key, *cols, "emitted_ms"], list(order), silent_ms)
    return _stateful(sdf, [key], ticker, f"{_fields(sdf, [key, *cols])}, emitted_ms bigint", "ProcessingTime")


class _Lock(StatefulProcessor):
    """The locked id of a link, and the last announced type of each of its systems, an entry each."""

    def __init__(self, type: int, order: list[str], columns: list[str]):
        self.type, self.order, self.columns = type, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.locked = handle.getValueState("locked", "sysid long")
        self.types = handle.getMapState("types", "sysid long", "type long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _batch(rows, self.order).reset_index(drop=True)
        system, kind = rows["sysid"].astype("Int64"), rows["type"].astype("Int64")
        told = kind.where((rows["mav_packet_type"] == "HEARTBEAT") & system.notna())
        before = {k[0]: v[0] for k, v in self.types.iterator()}
        known = told.groupby(system).ffill().astype("Int64")
        known = known.fillna(system.map(before).astype("Int64"))
        locked = self.locked.get()[0] if self.locked.exists() else None
        # rows before the lock pass whatever their system; its own announcement is the first row after it
        since = 0
        if locked is None:
            candidates = np.flatnonzero((told == self.type).fillna(False))
            since = int(candidates[0]) if len(candidates) else len(rows)
            if len(candidates):
                locked = int(system.iloc[since])
                self.locked.update((locked,))
        kept = (known.isna() | (known == self.type).fillna(False)).to_numpy(bool)
        if locked is not None:
            kept[since:] &= (system == locked).fillna(False).to_numpy(bool)[since:]
        kept |= system.isna().to_numpy(bool)
        for sysid, last in told.groupby(system).last().dropna().items():
            if before.get(sysid) != last:
                self.types.updateValue((int(sysid),), (int(last),))
        yield rows.loc[kept, self.columns]


def lock_stream(sdf: DataFrame, type: int = fixed.MAV_TYPE_QUADROTOR, link: str = "link", order: list[str] = ("seq",)) -> DataFrame:
    """Per link: lock on the first system that announces ``type`` and pass only its messages.

    State is the locked id and the last announced type of each system of the link; a batch writes the types that changed.
    """
    return _stateful(sdf, [link], _Lock(type, list(order), sdf.columns), _fields(sdf, sdf.columns))


def dead_band_stream(
    sdf: DataFrame,
    age: float = fixed.POSE_MIN_AGE_S,
    distance2: float = fixed.POSE_MIN_DISTANCE_SQUARED,
    rotation2: float = fixed.POSE_MIN_ROTATION_SQUARED,
    order: list[str] = ("seq",),
) -> DataFrame:
    """Poses that differ enough from the last emitted one; state is that one pose per entity."""
    gate = PoseGate(age, distance2, rotation2)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sdf.schema)
    columns = sdf.columns

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _batch(frames, list(order))
        before = np.array(state.get, float) if state.exists else None
        kept, after = gate.scan(rows[POSE].to_numpy(float), before)
        state.update(tuple(float(v) for v in after))
        yield rows.loc[kept, columns]

    held = ", ".join(f"{c} double" for c in POSE)
    return sdf.groupBy("name").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.NoTimeout)


class _Windows(StatefulProcessor):
    """The rows a drone's next windows need, as a list of the batches they came in.

    A batch appends its own rows; once more than twice the needed rows are held, the list is cut back to
    these. So a row is written twice at most, whatever the window's length.
    """

    def __init__(self, cols: list[str], size: int, stride: int, order: list[str], label: str, names: list[str]):
        self.cols, self.size, self.stride, self.order, self.label, self.names = cols, size, stride, order, label, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "rows long, held long")
        self.parts = handle.getListState("parts", "times array<double>, steps array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _batch(rows, self.order)
        width, need = len(self.cols), self.size - 1
        times, steps = rows[self.order[0]].to_numpy(float), rows[self.cols].to_numpy(float)
        before, held = self.seen.get() if self.seen.exists() else (0, 0)
        if held:
            parts = list(self.parts.get())
            times = np.concatenate([*(np.asarray(p[0], float) for p in parts), times])
            steps = np.concatenate([*(np.asarray(p[1], float).reshape(-1, width) for p in parts), steps])
        after, all_held = before + len(rows), held + len(rows)
        if need and all_held > 2 * need:
            keep = min(need, all_held)
            self.parts.put([(times[-keep:].tolist(), steps[-keep:].ravel().tolist())])
            all_held_after = keep
        else:
            all_held_after = all_held if need else 0
            if need:
                self.parts.appendValue((times[held:].tolist(), steps[held:].ravel().tolist()))
        self.seen.update((after, all_held_after))
        # a window ends with row number `end` (from 1); its place in the arrays counts from the oldest row held
        first = max(self.size, before + 1)
        first += -(first - self.size) % self.stride
        ends = np.arange(first, after + 1, self.stride)
        if not len(ends):
            return
        at = ends - (after - all_held) - self.size
        tensors = np.lib.stride_tricks.sliding_window_view(steps, self.size, axis=0)[at].transpose(0, 2, 1)
        labels = rows[self.label].to_numpy()[ends - before - 1]
        yield pd.DataFrame({
            **dict(zip(self.names, key)), "window_index": (ends - self.size) // self.stride, "row_start_index": ends - self.size,
            "row_end_index": ends, "window_start_timestamp": times[at], "window_end_timestamp": times[at + self.size - 1],
            self.label: labels.astype("int32"), "tensor": [[r.tolist() for r in t] for t in tensors],
        }, columns=self.names)


def window_stream(
    sdf: DataFrame, cols: list[str], size: int = fixed.WINDOW_SIZE, stride: int = fixed.STRIDE,
    keys: list[str] = ("run_id", "drone_id"), order: list[str] = ("timestamp", "seq"), label: str = "y_true",
) -> DataFrame:
    """Count windows over live rows. State per drone: a row counter and the last rows, appended batch by batch."""
    keys, cols = list(keys), list(cols)
    out = _fields(sdf, keys) + (
        ", window_index bigint, row_start_index bigint, row_end_index bigint, window_start_timestamp double, "
        f"window_end_timestamp double, {label} int, tensor array<array<float>>")
    names = [*keys, "window_index", "row_start_index", "row_end_index", "window_start_timestamp", "window_end_timestamp", label, "tensor"]
    return _stateful(sdf, keys, _Windows(cols, size, stride, list(order), label, names), out)
