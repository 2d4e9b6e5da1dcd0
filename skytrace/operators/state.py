"""Latest-state views of a telemetry history, and the pose change filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skytrace import fixed_values as fixed
from skytrace.functions import scalars as S
from skytrace.operators.ordered import (
    HOUR_MS, OWN_PIECE, PIECE, ROWS_BEFORE, carry_forward, spread, time_bucket,
)
from skytrace.session import cut_lineage, stored

GAUGES = [
    "roll_deg", "pitch_deg", "yaw_deg", "heading_deg", "groundspeed_mps", "airspeed_mps",
    "climb_mps", "throttle_pct", "lat", "lon", "alt_amsl_m", "alt_rel_m", "gps_fix_type",
    "gps_fix_name", "gps_satellites", "batt_voltage_v", "batt_current_a", "batt_remaining_pct",
    "mode", "armed",
]


def gauge_readings(df: DataFrame) -> dict[str, Column]:
    """What one message contributes to each gauge; NULL where it says nothing.

    A column the frame lacks contributes nothing. Positions come from the fused fix
    (GLOBAL_POSITION_INT), fix quality from GPS_RAW_INT.
    """
    have = set(df.columns)
    nothing = F.lit(None).cast("double")

    def of(kind: str, name: str, rule=lambda c: c.cast("double")) -> Column:
        if name not in have:
            return nothing
        return F.when(F.col("mav_packet_type") == kind, rule(F.col(name)))

    both = F.col("lat").isNotNull() & F.col("lon").isNotNull() if {"lat", "lon"} <= have else F.lit(False)
    mav = "mav_packet_type"
    return {
        "roll_deg": of("ATTITUDE", "roll", F.degrees),
        "pitch_deg": of("ATTITUDE", "pitch", F.degrees),
        "yaw_deg": of("ATTITUDE", "yaw", S.heading_deg),
        "hud_heading": of("VFR_HUD", "heading", S.wrap_deg),
        "groundspeed_mps": of("VFR_HUD", "groundspeed"),
        "airspeed_mps": of("VFR_HUD", "airspeed"),
        "climb_mps": of("VFR_HUD", "climb"),
        "throttle_pct": of("VFR_HUD", "throttle"),
        "lat": F.when(both, of("GLOBAL_POSITION_INT", "lat", lambda c: c / 1e7)),
        "lon": F.when(both, of("GLOBAL_POSITION_INT", "lon", lambda c: c / 1e7)),
        "alt_amsl_m": of("GLOBAL_POSITION_INT", "alt", lambda c: c / 1000.0),
        "alt_rel_m": of("GLOBAL_POSITION_INT", "relative_alt", lambda c: c / 1000.0),
        "gps_fix_type": of("GPS_RAW_INT", "fix_type", lambda c: c.cast("int")),
        "gps_satellites": of("GPS_RAW_INT", "satellites_visible", lambda c: c.cast("int")),
        "batt_voltage_v": of("SYS_STATUS", "voltage_battery", lambda c: F.when(c >= 0, c / 1000.0)),
        "batt_current_a": of("SYS_STATUS", "current_battery", lambda c: F.when(c != -1, c / 100.0)),
        "batt_remaining_pct": of("SYS_STATUS", "battery_remaining", lambda c: F.when(c != 255, c.cast("double"))),
        "mode": of("HEARTBEAT", "mode", lambda c: c.cast("string")) if "mode" in have else F.lit(None).cast("string"),
        "armed": F.when(F.col(mav) == "HEARTBEAT", S.is_armed(F.col("base_mode").cast("long")))
        if "base_mode" in have else F.lit(None).cast("boolean"),
    }


def sanitize_gauges(df: DataFrame) -> DataFrame:
    """Last touches before display: position check, heading wrap, throttle bounds."""
    return S.sanitize_position(df).withColumns({
        "heading_deg": S.wrap_deg("heading_deg"), "throttle_pct": S.clamp("throttle_pct", 0, 100),
    })


def gauges_asof(df: DataFrame, key: str = "sysid", order: list[str] = ("timestamp", "seq"), width_ms: int = HOUR_MS) -> DataFrame:
    """The gauge record as it stood after each message of a system."""
    order = list(order)
    readings = gauge_readings(df)
    ready = S.good_data(df).select(key, *order, "mav_packet_type", *[c.alias(n) for n, c in readings.items()])
    # The first yaw ever seen stands in for the heading until a HUD heading arrives.
    folded = carry_forward(
        ready, [key], order, time_bucket(order[0], width_ms), list(readings), {"first_yaw": "yaw_deg"}
    )
    heading = F.coalesce("hud_heading", F.when(F.col("yaw_deg").isNotNull(), F.col("first_yaw")))
    full = folded.withColumns({"heading_deg": heading, "gps_fix_name": S.fix_name("gps_fix_type")})
    return sanitize_gauges(full.select(key, *order, "mav_packet_type", *GAUGES))


def heading_fallback(df: DataFrame, key: str = "sysid", order: list[str] = ("timestamp", "seq")) -> DataFrame:
    """Heading after each message: last HUD heading, else the first yaw."""
    return gauges_asof(df, key, order).select(key, *order, "heading_deg")


def latest_gauges(df: DataFrame, key: str = "sysid", order: list[str] = ("timestamp", "seq")) -> DataFrame:
    """The present gauge record of each system, by aggregation alone."""
    readings = gauge_readings(df)
    rows = S.good_data(df).select(key, *order, *[c.alias(n) for n, c in readings.items()])
    at = F.struct(*order)
    latest = rows.groupBy(key).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in readings],
        F.min_by("yaw_deg", F.when(F.col("yaw_deg").isNotNull(), at)).alias("_first_yaw"),
    )
    full = latest.withColumns({
        "heading_deg": F.coalesce("hud_heading", "_first_yaw"), "gps_fix_name": S.fix_name("gps_fix_type"),
    })
    return sanitize_gauges(full.select(key, *GAUGES))


def latest_per_type(df: DataFrame, by: list[str] = (), order: list[str] = ("timestamp", "seq"), cols: list[str] = ()) -> DataFrame:
    """The newest message of each type (and of each ``by`` group)."""
    shown = list(cols) or [c for c in df.columns if c not in {*by, *order, "mav_packet_type"}]
    newest = F.max_by(F.struct(*order, *shown), F.struct(*order))
    return df.groupBy(*by, "mav_packet_type").agg(newest.alias("m")).select(*by, "mav_packet_type", "m.*")


def vehicle_identity(df: DataFrame, by: list[str] = (), order: list[str] = ("timestamp", "seq")) -> DataFrame:
    """Vehicle type from heartbeats: the first quadrotor, else the first that is no ground station."""
    beats = S.primary(df, "HEARTBEAT").filter(F.col("type") != fixed.MAV_TYPE_GCS)
    preferred = F.when(F.col("type") == fixed.MAV_TYPE_QUADROTOR, 0).otherwise(1)
    return beats.groupBy(*by).agg(F.min_by("type", F.struct(preferred, *order)).alias("vehicle_type"))


def lock_vehicle(
    df: DataFrame, type: int = fixed.MAV_TYPE_QUADROTOR, by: list[str] = (), order: list[str] = ("timestamp", "seq")
) -> DataFrame:
    """Messages that pass the lock on the first system announcing ``type``, per ``by`` link.

    Before the lock all systems pass unless their last heartbeat told another type;
    from the locking heartbeat on only the locked system does.
    """
    by, order = list(by), list(order)
    at = F.struct(*order)
    announced = S.primary(df, "HEARTBEAT").filter((F.col("type") == type) & F.col("sysid").isNotNull())
    lock = announced.groupBy(*by).agg(F.min_by("sysid", at).alias("_locked"), F.min(at).alias("_since"))
    told = df.withColumn("_told", F.when(F.col("mav_packet_type") == "HEARTBEAT", F.col("type")))
    known = carry_forward(told, [*by, "sysid"], order, time_bucket(order[0]), ["_told"])
    # One row per link; without links a single row.
    joined = known.join(lock, by, "left") if by else known.crossJoin(F.broadcast(lock))
    other_type = F.coalesce(F.col("_told") != type, F.lit(False))
    other_id = F.coalesce((at >= F.col("_since")) & (F.col("sysid") != F.col("_locked")), F.lit(False))
    anonymous = F.col("sysid").isNull()
    return joined.filter(anonymous | ~(other_type | other_id)).drop("_told", "_locked", "_since")


def log_entries(df: DataFrame) -> DataFrame:
    """Archived logs sorted by id; the first announcement of an id counts."""
    first = df.groupBy("id").agg(F.min_by(F.struct("size", "time_utc"), "seq").alias("e"))
    return first.select("id", S.log_name("id").alias("filename"), "e.size", "e.time_utc").orderBy("id")


# --- pose change filter ---------------------------------------------------
PIECE_POSES = 500_000  # rows of one piece meet in one Python task
POSE = ["time", "x", "y", "z", "qw", "qx", "qy", "qz"]


class PoseGate:
    """Compares poses with the last one let through; poses are rows of eight numbers, in the order of ``POSE``."""

    NEAR = 4  # following poses that are compared for all poses at once

    def __init__(self, age: float, distance2: float, rotation2: float):
        self.age, self.distance2, self.rotation2 = age, distance2, rotation2

    def passes(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Whether each pose of ``new`` passes after its (or the one) pose of ``old``."""
        old, new = old.T, new.T
        elapsed = new[0] - old[0]
        moved = (new[1] - old[1]) ** 2 + (new[2] - old[2]) ** 2 + (new[3] - old[3]) ** 2
        w, x, y, z = new[4:]
        ow, ox, oy, oz = old[4:]
        size = w * w + x * x + y * y + z * z
        # Vector part of inverse(new) * old; a pose without rotation doesn't turn.
        turn = (w * ox - x * ow - (y * oz - z * oy)) ** 2
        turn = turn + (w * oy - y * ow - (z * ox - x * oz)) ** 2
        turn = turn + (w * oz - z * ow - (x * oy - y * ox)) ** 2
        turned = turn > self.rotation2 * size * size
        return ~((elapsed > 0) & (elapsed < self.age)) & ((moved > self.distance2) | (turned & (size != 0)))

    def _next(self, state: np.ndarray, poses: np.ndarray, begin: int) -> int:
        """The first pose from ``begin`` on that passes after ``state``, or the number of poses."""
        width = 16
        while begin < len(poses):
            hit = self.passes(state, poses[begin : begin + width])
            if hit.any():
                return begin + int(hit.argmax())
            begin, width = begin + width, min(2 * width, 65_536)
        return len(poses)

    def scan(self, poses: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Which poses pass, and the state after them. The very first pose only primes."""
        kept = np.zeros(len(poses), bool)
        if not len(poses):
            return kept, state
        near = np.zeros(len(poses), np.int8)  # distance to the first of the next poses that passes
        for k in range(min(self.NEAR, len(poses) - 1), 0, -1):
            near[:-k][self.passes(poses[:-k], poses[k:])] = k
        at = 0 if state is None else self._next(state, poses, 0)
        if state is not None and at < len(poses):
            kept[at] = True
        steps = near.tolist()
        while at < len(poses):
            state = poses[at]
            at = at + steps[at] if steps[at] else self._next(state, poses, at + 1 + self.NEAR)
            if at < len(poses):
                kept[at] = True
        return kept, state


def dead_band(
    poses: DataFrame,
    age: float = fixed.POSE_MIN_AGE_S,
    distance2: float = fixed.POSE_MIN_DISTANCE_SQUARED,
    rotation2: float = fixed.POSE_MIN_ROTATION_SQUARED,
    order: list[str] = ("seq",),
    target_rows: int = PIECE_POSES,
) -> DataFrame:
    """Poses that differ enough from the last emitted pose of their entity.

    ``poses`` holds name, time, position, rotation and an arrival number ``seq``. Each
    decision depends on the one before, so a large entity is cut into pieces that start
    from the state the previous piece ends in. All pieces run in parallel from a provisional
    start. Then only pieces run again whose start turned out to be another, until none is left, which is
    the sequential result. One state row per piece is all that passes between rounds. A piece whose
    end doesn't depend on its start, as with most movement, ends the chain: it runs twice at most.
    """
    gate = PoseGate(age, distance2, rotation2)
    order = list(order)
    cell = F.floor(F.col(order[0]) / 1000).cast("long")
    pieces = spread(poses, ["name"], cell, target_rows).drop(OWN_PIECE, ROWS_BEFORE)
    columns = [f.name for f in poses.schema]
    state_schema = "name string, _piece long, " + ", ".join(f"{c} double" for c in POSE)
    by = ["name", PIECE]

    def start_of(states: pd.DataFrame) -> np.ndarray | None:
        return None if states.empty else states[POSE].to_numpy(float)[0]

    def outgoing(key, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame(columns=["name", PIECE, *POSE])
        rows = rows.sort_values(order, kind="stable")
        _, state = gate.scan(rows[POSE].to_numpy(float), start_of(states))
        return pd.DataFrame([(*key, *state)], columns=["name", PIECE, *POSE])

    def emitted(key, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        kept, _ = gate.scan(rows[POSE].to_numpy(float), start_of(states))
        return rows.loc[kept, columns]

    def run(of: DataFrame, fn, starts: DataFrame, schema) -> DataFrame:
        return of.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(fn, schema)

    starts = poses.sparkSession.createDataFrame([], state_schema)
    if not pieces.filter(F.col(PIECE) > 0).isEmpty():
        pieces = stored(pieces, "pieces")
        moving = pieces.select(*by, *order, *[c for c in POSE if c not in order])
        following = Window.partitionBy("name").orderBy(PIECE)
        ends = cut_lineage(run(moving, outgoing, starts, state_schema))
        while True:
            given = ends.select("name", F.lead(PIECE).over(following).alias(PIECE), *POSE).filter(F.col(PIECE).isNotNull())
            given = cut_lineage(given)
            changed = given.exceptAll(starts)
            if changed.isEmpty():
                break
            again = run(moving.join(changed.select(*by), by, "left_semi"), outgoing, changed, state_schema)
            ends = cut_lineage(ends.join(changed.select(*by), by, "left_anti").unionByName(again))
            starts = given
    return run(pieces, emitted, starts, poses.schema)
