"""Column expressions for single cells: parsing, scaling, guarding, classifying."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, NumericType

from skytrace import fixed_values as fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text cells -----------------------------------------------------------
def format_cell(c: Column | str, kind: DataType | None = None) -> Column:
    """Render a value the way capture files hold it (``kind`` is the column's type)."""
    c = _col(c)
    if isinstance(kind, ArrayType):
        text = F.array_join(F.transform(c, lambda v: format_cell(v, kind.elementType)), ";")
    elif isinstance(kind, BinaryType):
        hex_pairs = F.regexp_extract_all(F.hex(c), F.lit("(..)"), 1)
        text = F.array_join(F.transform(hex_pairs, lambda h: F.conv(h, 16, 10)), ";")
    elif isinstance(kind, BooleanType):
        text = F.when(c, "True").otherwise("False")
        text = F.when(c.isNotNull(), text)
    else:
        text = F.translate(c.cast("string"), ",\n", "; ")
    return F.coalesce(text, F.lit(fixed.NULL_TEXT))


def format_cells(df: DataFrame) -> DataFrame:
    return df.select(*[format_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def is_labelled(c: Column | str) -> Column:
    """True unless the cell is NULL or spells ``null`` in any case."""
    return F.lower(F.coalesce(_col(c).cast("string"), F.lit(fixed.NULL_TEXT))) != fixed.NULL_TEXT


def null_if_text(c: Column | str) -> Column:
    return F.when(is_labelled(c), _col(c))


def num(c: Column | str, type: str = "double") -> Column:
    """Tolerant cast: anything unparsable becomes NULL, also under ANSI mode."""
    return _col(c).try_cast(type)


def to_millis(c: Column | str) -> Column:
    return (_col(c) * 1000).cast("long")


# --- frames ---------------------------------------------------------------
def payload_union(dictionary: DataFrame, reserved: list[str] | None = None) -> DataFrame:
    """Distinct payload field names of a message dictionary minus reserved names, sorted."""
    reserved = fixed.RESERVED_FIELDS if reserved is None else reserved
    return (
        dictionary.select(F.explode("fields").alias("field"))
        .filter(~F.col("field").isin(reserved))
        .distinct()
        .orderBy("field")
    )


def canonical_columns(df: DataFrame, payload: list[str]) -> DataFrame:
    """The capture column order; fields the frame lacks hold the null text."""
    order = (
        fixed.IDENTITY_FIELDS
        + fixed.MAV_HEADER_FIELDS
        + sorted(payload)
        + [f"ip_{f}" for f in fixed.IP_HEADER_FIELDS]
        + [f"udp_{f}" for f in fixed.UDP_HEADER_FIELDS]
        + [f"tcp_{f}" for f in fixed.TCP_HEADER_FIELDS]
        + fixed.TRAILER_FIELDS
    )
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fixed.NULL_TEXT).alias(c) for c in order])


def numeric_only(df: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """Drop identity and header columns, keep numeric ones, NULL (and NaN) becomes 0."""
    drop = set(fixed.NON_FEATURE_FIELDS if drop is None else drop)
    kept = [f.name for f in df.schema if f.name not in drop and isinstance(f.dataType, NumericType)]
    return df.select(*kept).fillna(0)


def primary(df: DataFrame, message_type: str) -> DataFrame:
    return df.filter(F.col("mav_packet_type") == message_type)


def good_data(df: DataFrame) -> DataFrame:
    return df.filter(F.col("mav_packet_type") != "BAD_DATA")


def align(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Fixed feature order: absent columns are 0, extra ones go away, NULL becomes 0."""
    have = set(df.columns)
    features = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
        for c in cols
    ]
    return df.select(*keep, *features)


def validate_features(df: DataFrame, core: list[str], keep: list[str] = ()) -> list[str]:
    """Sorted feature names, or an error when a core one lacks or a clock leaked in."""
    names = sorted(set(df.columns) - set(keep))
    missing = sorted(set(core) - set(names))
    if missing:
        raise ValueError(f"core feature columns missing: {missing}")
    clocks = [c for c in names if "timestamp" in c.lower() or c.startswith("time_")]
    if clocks:
        raise ValueError(f"clock columns among the features: {clocks}")
    return names


def feature_union(frames: list[DataFrame], keep: list[str] = ()) -> list[str]:
    return sorted({c for df in frames for c in df.columns} - set(keep))


# --- names and classes ----------------------------------------------------
def run_class(attack: Column | str) -> Column:
    """``none`` in any case is benign; everything else, a missing value too, is an attack."""
    return F.when(F.lower(F.coalesce(_col(attack), F.lit(""))) == "none", "benign").otherwise("attack")


def run_shape(name: Column | str, strict: bool = False) -> Column:
    """Suffix of a run name from its fourth ``_`` part on; ``strict`` reads n/s/e only."""
    name = _col(name)
    if strict:
        found = F.regexp_extract(name, fixed.STRICT_SHAPE_PATTERN, 1)
        return F.when(found != "", found).otherwise("unknown")
    parts = F.split(name, "_")
    n = F.size(parts)
    return F.when(n < 4, "unknown").otherwise(F.array_join(F.slice(parts, 4, F.greatest(n - 3, F.lit(1))), "_"))


def attack_type_of(kind: Column | str) -> Column:
    key = F.lower(_col(kind))
    known = F.create_map(*[F.lit(x) for pair in fixed.ATTACK_KIND_TO_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.replace(key, F.lit("-"), F.lit("_")))


def run_number(name: Column | str) -> Column:
    return F.regexp_extract(_col(name), fixed.TRAILING_NUMBER_PATTERN, 1).try_cast("int")


def dst_slug(cls: Column | str, kind: Column | str) -> Column:
    packed = F.lower(F.replace(_col(kind), F.lit("-"), F.lit("")))
    return F.when(_col(cls) == "benign", "nominal").otherwise(packed)


def dst_run_name(cls: Column | str, kind: Column | str, source_name: Column | str) -> Column:
    attack = F.when(_col(cls) == "benign", "none").otherwise(attack_type_of(kind))
    number = F.coalesce(run_number(source_name), F.lit(0))
    return F.concat(
        F.lit("run_legacy-"), dst_slug(cls, kind), F.lit("-"), number.cast("string"),
        F.lit("_"), attack, F.lit("_legacy"),
    )


def log_name(id: Column | str) -> Column:
    return F.format_string("%08d.BIN", _col(id))


def log_time(epoch_seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(epoch_seconds))


def address_fields(drone_id: Column | str) -> dict[str, Column]:
    """The ``ip_*`` cells a drone's number determines; the rest stay null text."""
    n = _col(drone_id).cast("long")
    companion = F.format_string("10.13.%d.3", n)
    gateway = F.format_string("10.13.%d.1", n)
    known = {"version": F.lit("4"), "proto": F.lit("6")}
    known |= {f: companion for f in ("src", "src_host", "addr", "host")}
    known |= {f: gateway for f in ("dst", "dst_host")}
    return {f"ip_{f}": known.get(f, F.lit(fixed.NULL_TEXT)) for f in fixed.IP_HEADER_FIELDS}


# --- physics --------------------------------------------------------------
def heading_deg(radians: Column | str) -> Column:
    return F.pmod(F.degrees(_col(radians)), F.lit(360.0))


def wrap_deg(degrees: Column | str) -> Column:
    return F.pmod(_col(degrees).cast("double"), F.lit(360.0))


def magnitude(*cols: Column | str) -> Column:
    return F.sqrt(reduce(add, [_col(c) * _col(c) for c in cols]))


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    c = _col(c).cast("double")
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def drop_sentinels(df: DataFrame) -> DataFrame:
    """Battery readings that mean "not measured" become NULL."""
    v, a, r = F.col("voltage_battery"), F.col("current_battery"), F.col("battery_remaining")
    return df.withColumns({
        "voltage_battery": F.when(v >= 0, v),
        "current_battery": F.when(a != -1, a),
        "battery_remaining": F.when(r != 255, r),
    })


def scale_units(df: DataFrame) -> DataFrame:
    """Wire integers to SI: 1e7 degrees, millimetres, millivolts, centiamperes."""
    rules = {
        "lat": ("lat", 1e7), "lon": ("lon", 1e7),
        "alt_amsl_m": ("alt", 1000.0), "alt_rel_m": ("relative_alt", 1000.0),
        "batt_voltage_v": ("voltage_battery", 1000.0), "batt_current_a": ("current_battery", 100.0),
    }
    have = set(df.columns)
    return df.withColumns({out: F.col(src) / F.lit(by) for out, (src, by) in rules.items() if src in have})


def sanitize_position(df: DataFrame, lat: str = "lat", lon: str = "lon", fix: str = "gps_fix_type") -> DataFrame:
    """NULL both coordinates when missing, at the origin, out of range or without a 2-D fix."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    good = (
        la.isNotNull() & lo.isNotNull()
        & ~((F.abs(la) < 1e-9) & (F.abs(lo) < 1e-9))
        & la.between(-90.0, 90.0) & lo.between(-180.0, 180.0)
        & F.coalesce(F.col(fix) >= 2, F.lit(True))
    )
    return df.withColumns({lat: F.when(good, la), lon: F.when(good, lo)})


def firmware_version(word: Column | str) -> Column:
    """``major.minor.patch`` from bits 8-15, 16-23 and 24-31 of the version word."""
    word = _col(word).cast("long")
    byte = lambda shift: F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(255)).cast("string")
    return F.when(word.isNotNull(), F.concat_ws(".", byte(8), byte(16), byte(24)))


def is_armed(base_mode: Column | str) -> Column:
    return _col(base_mode).bitwiseAND(F.lit(fixed.SAFETY_ARMED_FLAG)) != 0


def has_fix(fix_type: Column | str, minimum: int = 3) -> Column:
    return _col(fix_type) >= minimum


def fix_name(fix_type: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fixed.GPS_FIX_NAMES.items() for x in pair])
    return F.try_element_at(names, _col(fix_type).cast("int"))


# --- traffic --------------------------------------------------------------
def protocol_version(magic: Column | str) -> Column:
    magic = _col(magic)
    return F.when(magic == fixed.MAGIC_V1, 1).when(magic == fixed.MAGIC_V2, 2)


def packet_filter(df: DataFrame, source: str, types: list[str] | None = None) -> DataFrame:
    types = fixed.PASSIVE_TELEMETRY_TYPES if types is None else types
    return df.filter((F.col("ip_src") == source) & F.col("mav_packet_type").isin(types))


# --- windows --------------------------------------------------------------
def n_windows(n: Column | str, size: int | Column, stride: int | Column) -> Column:
    """How many windows of ``size`` rows, ``stride`` apart, fit into ``n`` rows."""
    n = _col(n)
    size = size if isinstance(size, Column) else F.lit(size)
    stride = stride if isinstance(stride, Column) else F.lit(stride)
    return F.when(n >= size, F.floor((n - size) / stride) + 1).otherwise(F.lit(0)).cast("long")
