"""Feature sets per message type: differences, rolling statistics, moments, magnitudes.

Spark partitions, shuffles and sorts the rows; inside a task one vectorised pass per
Arrow batch computes all columns. The pass streams: it keeps the last rows of the
previous batch, so no series is ever held whole. A series larger than one piece is
cut by ``ordered.spread`` with enough preceding rows for every window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skytrace import fixed_values as fixed
from skytrace.functions.scalars import num, primary
from skytrace.operators.ordered import OWN_PIECE, PIECE, ROWS_BEFORE, TARGET_ROWS, spread, time_bucket
from skytrace.session import shuffle_partitions

KEYS = ["run_id", "drone_id"]
ORDER = ["timestamp", "seq"]
MINUTE_MS = 60_000
# Rows a value can depend on: a 50-row mean of products of 50-row means of a lag.
HALO = 2 * max(fixed.LONG_WINDOWS)
_BLOCK = 1024


def feature_names(message_type: str) -> list[str]:
    """Sorted feature columns of a message type: 129, 165 or 114 of them."""
    names: list[str] = []
    for c in fixed.CORE_FEATURES[message_type]:
        names += [c, f"{c}_d1", f"{c}_d2", f"{c}_zscore"]
        names += [f"{c}_{s}_{w}" for w in fixed.SHORT_WINDOWS for s in ("mean", "std", "range")]
        if c in fixed.SHORT_WINDOW_ONLY:
            continue
        for w in fixed.LONG_WINDOWS:
            names += [f"{c}_autocorr_{w}", f"{c}_kurt_{w}"]
            names += [f"{c}_skew_{w}"] if message_type in fixed.SKEW_TYPES else []
            names += [] if w in fixed.SHORT_WINDOWS else [f"{c}_std_{w}", f"{c}_range_{w}"]
    if message_type == "ATTITUDE":
        names += ["rate_mag", "rate_mag_std_20", "attitude_mag"]
    return sorted(names)


class _Stats:
    """Mean, central sums and range of the last ``w`` rows, all columns at once.

    Works offset by offset on blocks that stay in the CPU cache. Everything is taken
    relative to the current row, then to the mean, so nothing cancels.
    """

    def __init__(self, x: np.ndarray, count: np.ndarray, w: int, high: bool):
        rows, cols = x.shape
        self.n = np.maximum(count, 1).astype(float)[:, None]
        shape = (rows, cols)
        self.mean, self.m2, self.lo, self.hi = (np.zeros(shape) for _ in range(4))
        self.m3, self.m4 = (np.zeros(shape), np.zeros(shape)) if high else (None, None)
        padded = np.concatenate([np.zeros((w - 1, cols)), x])
        for a in range(0, rows, _BLOCK):
            b = min(a + _BLOCK, rows)
            # Offsets that reach before some row's series need a mask; the others do not.
            least = int(count[a:b].min(initial=w))
            inside = lambda j: (count[a:b] > j).astype(float)[:, None]
            back = lambda j: padded[a + w - 1 - j: b + w - 1 - j]
            here, lo, hi = x[a:b], self.lo[a:b], self.hi[a:b]
            total, off, power = (np.zeros((b - a, cols)) for _ in range(3))
            for j in range(1, w):
                np.subtract(back(j), here, out=off)
                if j >= least:
                    np.multiply(off, inside(j), out=off)
                total += off
                np.minimum(lo, off, out=lo)
                np.maximum(hi, off, out=hi)
            mean = self.mean[a:b]
            np.add(here, total / self.n[a:b], out=mean)
            lo += here
            hi += here
            for j in range(w):
                np.subtract(back(j), mean, out=off)
                if j >= least:
                    np.multiply(off, inside(j), out=off)
                np.multiply(off, off, out=power)
                self.m2[a:b] += power
                if high:
                    off *= power
                    self.m3[a:b] += off
                    power *= power
                    self.m4[a:b] += power
        self.flat = self.lo == self.hi
        self.mean[self.flat], self.m2[self.flat] = x[self.flat], 0.0

    def std(self, least: int = 1) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.sqrt(self.m2 / (self.n - 1))
        return np.where(self.n >= max(least, 2), value, 0.0)

    def span(self, least: int = 1) -> np.ndarray:
        return np.where(self.n >= least, self.hi - self.lo, 0.0)

    def skew(self, least: int) -> np.ndarray:
        n = self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.sqrt(n) * self.m3 / self.m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)
        return np.where((n >= least) & ~self.flat & (self.m2 / n > 1e-14), value, 0.0)

    def kurt(self, least: int) -> np.ndarray:
        n = self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            plain = n * self.m4 / self.m2**2 - 3
            value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * plain + 6)
        value = np.where(self.flat, -3.0, np.where(self.m2 / n > 1e-14, value, 0.0))
        return np.where(n >= least, value, 0.0)


def _floor(std: np.ndarray) -> np.ndarray:
    return np.where(std == 0, fixed.STD_FLOOR, std)


def _previous(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], x[:-1]])


def _autocorr(x: np.ndarray, pos: np.ndarray, stats: _Stats, w: int) -> np.ndarray:
    """Lag-1 autocorrelation; statistics of the lagged series are those one row earlier."""
    least = w // 2
    off = x - stats.mean
    product = off * _previous(off)
    count = np.clip(pos - least + 1, 0, w)
    product[pos < least] = 0.0
    inside = _Stats(product, count, w, high=False)
    spread_ = _floor(stats.std(least)) * _floor(_previous(stats.std(least)))
    return np.where((count >= least)[:, None], inside.mean / spread_, 0.0)


def _compute(message_type: str, x: np.ndarray, pos: np.ndarray) -> dict[str, np.ndarray]:
    """All feature columns; ``x`` holds the core columns, ``pos`` the 0-based row in its series."""
    core = fixed.CORE_FEATURES[message_type]
    out: dict[str, np.ndarray] = {}

    def put(suffix: str, values: np.ndarray, cols: list[str]) -> None:
        for i, c in enumerate(cols):
            out[f"{c}_{suffix}" if suffix else c] = values[:, i]

    started = (pos >= 1)[:, None]
    d1 = np.where(started, x - _previous(x), 0.0)
    put("", x, core)
    put("d1", d1, core)
    put("d2", np.where(started, d1 - _previous(d1), 0.0), core)

    deep_at = [i for i, c in enumerate(core) if c not in fixed.SHORT_WINDOW_ONLY]
    deep = [core[i] for i in deep_at]
    for w in sorted({*fixed.SHORT_WINDOWS, *fixed.LONG_WINDOWS}):
        long = w in fixed.LONG_WINDOWS
        stats = _Stats(x, np.minimum(pos + 1, w), w, high=long)
        if w in fixed.SHORT_WINDOWS:
            put(f"mean_{w}", stats.mean, core)
            put(f"std_{w}", stats.std(), core)
            put(f"range_{w}", stats.span(), core)
        if w == fixed.ZSCORE_WINDOW:
            put("zscore", np.where(started, (x - stats.mean) / _floor(stats.std()), 0.0), core)
        if long:
            least = w // 2
            put(f"kurt_{w}", stats.kurt(least)[:, deep_at], deep)
            put(f"autocorr_{w}", _autocorr(x, pos, stats, w)[:, deep_at], deep)
            if message_type in fixed.SKEW_TYPES:
                put(f"skew_{w}", stats.skew(least)[:, deep_at], deep)
            if w not in fixed.SHORT_WINDOWS:
                put(f"std_{w}", stats.std(least)[:, deep_at], deep)
                put(f"range_{w}", stats.span(least)[:, deep_at], deep)
    if message_type == "ATTITUDE":
        of = lambda *cols: np.sqrt(sum(x[:, core.index(c)] ** 2 for c in cols))
        rate = of("rollspeed", "pitchspeed", "yawspeed")
        out["rate_mag"] = rate
        out["rate_mag_std_20"] = _Stats(rate[:, None], np.minimum(pos + 1, 20), 20, high=False).std(10)[:, 0]
        out["attitude_mag"] = of("roll", "pitch", "yaw")
    return out


def _changes(batch: pa.RecordBatch, group: list[str], last: list | None) -> np.ndarray:
    """True where a row belongs to another series than the row before it."""
    first = np.ones(batch.num_rows, dtype=bool)
    first[1:] = False
    for c in group:
        col = batch.column(c)
        after, before = col.slice(1), col.slice(0, len(col) - 1)
        # NULL keys are a series of their own
        differ = pc.fill_null(pc.not_equal(after, before), False)
        differ = pc.or_(differ, pc.xor(pc.is_null(after), pc.is_null(before)))
        first[1:] |= differ.to_numpy(zero_copy_only=False)
    if last is not None:
        first[0] = [batch.column(c)[0].as_py() for c in group] != last
    return first


def _kernel(message_type: str, keys: list[str], keep: list[str], names: list[str]) -> Callable:
    core = fixed.CORE_FEATURES[message_type]
    group = [*keys, PIECE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_x, tail_pos, last = np.empty((0, len(core))), np.empty(0, dtype=np.int64), None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            first, at = _changes(batch, group, last), np.arange(n)
            start = np.maximum.accumulate(np.where(first, at, -1))
            # Rows before the first change continue the series of the previous batch.
            going = tail_pos[-1] + 1 if len(tail_pos) else 0
            pos = np.where(start >= 0, at - start, at + going)
            new = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in core]).astype(float)
            x = np.concatenate([tail_x, np.nan_to_num(new, nan=0.0)])
            pos = np.concatenate([tail_pos, pos])
            values = _compute(message_type, x, pos)
            known = len(tail_pos)
            mine = pc.equal(batch.column(PIECE), batch.column(OWN_PIECE))
            all_mine = mine.true_count == n
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(np.ascontiguousarray(values[c][known:])) for c in names]
            if not all_mine:
                columns = [c.filter(mine) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
            tail_x, tail_pos = x[-HALO:], pos[-HALO:]
            last = [batch.column(c)[n - 1].as_py() for c in group]

    return run


def engineer(
    df: DataFrame,
    message_type: str,
    keys: list[str] | None = None,
    order: list[str] | None = None,
    keep: list[str] = (),
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """The full feature frame of one message type, one output row per input row.

    ``keep`` names further columns to carry along (labels, run class). Unparsable and
    missing readings count as 0 before any statistic.
    """
    keys, order = keys or KEYS, order or ORDER
    core = fixed.CORE_FEATURES[message_type]
    carried = list(dict.fromkeys([*keys, *order, *keep]))
    source = primary(df, message_type).select(
        *carried, *[num(c).alias(c) for c in core if c not in carried]
    )
    names = feature_names(message_type)
    pieces = spread(source, keys, time_bucket(order[0], MINUTE_MS), target_rows, HALO).drop(ROWS_BEFORE)
    schema = StructType(
        [pieces.schema[c] for c in carried] + [StructField(c, DoubleType()) for c in names]
    )
    # A fixed number of partitions: the pass is bound by CPU, so few bytes are no reason
    # to merge partitions.
    return (
        pieces.repartition(shuffle_partitions(df.sparkSession), *keys, PIECE)
        .sortWithinPartitions(*keys, PIECE, *[F.col(c).asc_nulls_last() for c in order])
        .mapInArrow(_kernel(message_type, list(keys), carried, names), schema)
    )
