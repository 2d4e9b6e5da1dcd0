"""Fixed values of the telemetry format.

Word lists, constants and patterns that results depend on. They are data, not
logic, and must stay exactly as written.
"""

NULL_TEXT = "null"

# --- capture layout -------------------------------------------------------
IDENTITY_FIELDS = ["mav_packet_type", "sim_uuid", "timestamp"]

MAV_HEADER_FIELDS = [
    "magic", "payloadLength", "incompatibilityFlags", "compatibilityFlags",
    "seq", "sysid", "compid", "msgid", "checksum", "signature",
]

IP_HEADER_FIELDS = [
    "version", "hdr_len", "tos", "len", "id", "flags", "frag_offset", "ttl",
    "proto", "checksum", "checksum_status", "src", "src_host", "addr", "host",
    "dst", "dst_host", "payload",
]

UDP_HEADER_FIELDS = [
    "srcport", "dstport", "length", "checksum", "checksum_status", "payload", "text",
]

TCP_HEADER_FIELDS = [
    "srcport", "dstport", "seq", "ack", "hdr_len", "flags", "flags_str",
    "window_size", "checksum", "checksum_status", "urgent_pointer", "options",
    "options_nop", "options_timestamp", "payload", "text",
]

TRAILER_FIELDS = ["frame_timestamp", "attack_type"]

RESERVED_FIELDS = (
    IDENTITY_FIELDS
    + MAV_HEADER_FIELDS
    + [f"ip_{f}" for f in IP_HEADER_FIELDS]
    + [f"udp_{f}" for f in UDP_HEADER_FIELDS]
    + [f"tcp_{f}" for f in TCP_HEADER_FIELDS]
    + TRAILER_FIELDS
)

# Columns that never become features. The captures' own headers plus the
# clocks a message payload may carry.
PAYLOAD_CLOCK_FIELDS = ["time_boot_ms", "time_usec", "udp_time_relative", "tcp_time_relative"]
NON_FEATURE_FIELDS = RESERVED_FIELDS + PAYLOAD_CLOCK_FIELDS

DRONE_FILE_PATTERN = r"drone_(\d+)\.csv"
LEGACY_DRONE_PATTERN = r"-([0-9]+)/[^/]+\.csv$"
TRAILING_NUMBER_PATTERN = r"-(\d+)$"
RUN_DIR_PATTERN = r"/(?:[a-z_]+=)?(run_[^/]+)/"
STRICT_SHAPE_PATTERN = r"(n\d+_s\d+_e\d+)$"

# --- labels ---------------------------------------------------------------
ATTACK_KIND_TO_TYPE = {
    "attitude-spoof": "attitude_spoof",
    "battery-spoof": "battery_spoof",
    "criticalerror-spoof": "critical_error_spoof",
    "emergencystatus-spoof": "emergency_status_spoof",
    "gps-spoof": "gps_spoof",
    "satellite-spoof": "satellite_spoof",
    "systemstatus-spoof": "system_status_spoof",
    "vfr-hud-spoof": "vfr_hud_spoof",
}

# --- features -------------------------------------------------------------
CORE_FEATURES = {
    "ATTITUDE": ["roll", "pitch", "yaw", "rollspeed", "pitchspeed", "yawspeed"],
    "GPS_RAW_INT": [
        "lat", "lon", "alt", "alt_ellipsoid", "cog", "vel", "eph", "epv",
        "satellites_visible",
    ],
    "VFR_HUD": ["airspeed", "groundspeed", "heading", "throttle", "alt", "climb"],
}

# Columns that get only the short windows (no autocorrelation, no moments).
SHORT_WINDOW_ONLY = {"satellites_visible"}
# Message types that get rolling skewness.
SKEW_TYPES = {"ATTITUDE"}
SHORT_WINDOWS = (5, 10, 20)
LONG_WINDOWS = (20, 50)
ZSCORE_WINDOW = 20
STD_FLOOR = 1e-9

FLAT_LINE_FIELDS = {
    "ATTITUDE": ["roll", "pitch", "yaw", "rollspeed", "pitchspeed", "yawspeed"],
    "GPS_RAW_INT": ["lat", "lon", "alt", "vel"],
    "VFR_HUD": ["airspeed", "groundspeed", "alt", "climb"],
}
FLAT_LINE_THRESHOLD = 1e-6

WINDOW_SIZE = 80
STRIDE = 2
TEST_FRACTION = 0.2
VAL_FRACTION = 0.2
SPLIT_SEED = 42

# --- reports --------------------------------------------------------------
RADIANS_TO_DEGREES = 57.296
SEVERITY_RANK = {"SEVERE": 0, "WARN": 1, "INFO": 2}

# Texts of audit warnings, in the order the rules apply.
WARNING_TEXTS = {
    "below_window_only": "%d run(s) have rows < window_size (produce 0 windows): %s",
    "below_window": "%d run(s) have rows < window_size: %s",
    "zero_windows": "%d run(s) produce 0 windows for other reasons: %s",
    "one_class_shape": "shape `%s` exists only in %s class",
    "no_runs": "%s class has 0 runs — cannot train",
    "few_runs": "%s class has %d run(s) — not enough for run-level train/val/test (need ≥3)",
    "fragile": "%s class has %d run(s) — fragile train/val/test; recommend ≥5",
    "empty_split": "%s split (test_frac=0.2, val_frac=0.2) projects train=%d val=%d test=%d — at least one is empty",
    "minority": "val/test sets may not contain both classes given minority class size; consider leave-one-run-out or collect more runs",
    "lopsided": "window balance attack:benign = %s:%s (%.2f:1); consider more %s data",
    "balance": "window balance attack:benign = %s:%s (%.2f:1)",
    "fewer_benign": "benign runs (%d) < attack runs (%d); collect more benign runs",
    "fewer_attack": "attack runs (%d) < benign runs (%d); collect more attack runs",
    "dominant": "shape `%s` dominates %d%% of windows; consider per-shape metrics or more diverse data",
    "no_flight": "%d run(s) skipped (missing flight table; convert the capture first)",
    "no_metadata": "%d run(s) skipped (missing/unreadable metadata.json)",
}

SWEEP_COLUMNS = [
    "model", "window_size", "stride", "return_code", "wall_seconds",
    "val_attack_f1", "test_attack_f1", "best_threshold",
    "val_attack_precision", "val_attack_recall", "val_attack_support",
    "test_attack_precision", "test_attack_recall", "test_attack_support",
]
TRAIN_LOG_METRIC_PATTERN = r"(?m)^\s*Attack\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+(\d+)\s*$"
TRAIN_LOG_THRESHOLD_PATTERN = r"Optimal threshold \(from val\)\s*:\s*([\d.]+)"
STAGE_LOG_PATTERN = r"\[(stage\d+) instance=(\d+)\] step=(\S+) elapsed=([\d.]+)s"

CACHE_FORMAT_VERSION = 2

# --- live telemetry -------------------------------------------------------
MAV_TYPE_QUADROTOR = 2
MAV_TYPE_GCS = 6
SAFETY_ARMED_FLAG = 128
MAGIC_V1 = 0xFE
MAGIC_V2 = 0xFD
EMIT_PERIOD = "100 milliseconds"
POSE_MIN_AGE_S = 0.03
POSE_MIN_DISTANCE_SQUARED = 1e-4
POSE_MIN_ROTATION_SQUARED = 1e-4

GPS_FIX_NAMES = {
    0: "GPS_FIX_TYPE_NO_GPS",
    1: "GPS_FIX_TYPE_NO_FIX",
    2: "GPS_FIX_TYPE_2D_FIX",
    3: "GPS_FIX_TYPE_3D_FIX",
    4: "GPS_FIX_TYPE_DGPS",
    5: "GPS_FIX_TYPE_RTK_FLOAT",
    6: "GPS_FIX_TYPE_RTK_FIXED",
    7: "GPS_FIX_TYPE_STATIC",
    8: "GPS_FIX_TYPE_PPP",
}

PASSIVE_TELEMETRY_TYPES = [
    "HEARTBEAT", "SYS_STATUS", "GPS_RAW_INT", "GLOBAL_POSITION_INT", "ATTITUDE",
    "ALTITUDE", "BATTERY_STATUS", "VFR_HUD", "STATUSTEXT", "MISSION_CURRENT",
    "NAV_CONTROLLER_OUTPUT", "RADIO_STATUS",
]
