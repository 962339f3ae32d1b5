"""Column contracts: session log, host inventory, feature names and class codes."""

from __future__ import annotations

from pyspark.sql import types as T

SESSION_SCHEMA = T.StructType(
    [
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("source_port", T.LongType()),
        T.StructField("destination_port", T.LongType()),
        T.StructField("source_bytes", T.LongType()),
        T.StructField("destination_bytes", T.LongType()),
        T.StructField("network_bytes", T.LongType()),
        T.StructField("source_packets", T.LongType()),
        T.StructField("destination_packets", T.LongType()),
        T.StructField("ip_protocol", T.LongType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("event_provider", T.StringType()),
        T.StructField("first_packet", T.LongType()),  # epoch milliseconds
        T.StructField("last_packet", T.LongType()),
    ]
)

# Header names of the session CSV for each column above.
SESSION_CSV_NAMES = {
    "source_ip": "source.ip",
    "destination_ip": "destination.ip",
    "source_port": "source.port",
    "destination_port": "destination.port",
    "source_bytes": "source.bytes",
    "destination_bytes": "destination.bytes",
    "network_bytes": "network.bytes",
    "source_packets": "source.packets",
    "destination_packets": "destination.packets",
    "ip_protocol": "ipProtocol",
    "protocol": "protocol",
    "event_provider": "event.provider",
    "first_packet": "firstPacket",
    "last_packet": "lastPacket",
}

LABEL_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("facility", T.StringType()),
        T.StructField("blue_team", T.StringType()),
        T.StructField("red_team", T.BooleanType()),
    ]
)

# Class codes.
INACTIVE = -1
UNRESPONSIVE, IGNORED, RED, BLUE, GRAY = 0, 1, 2, 3, 4
ROLE_NAMES = {0: "unresp", 1: "ignored", 2: "red", 3: "blue", 4: "gray"}
FACILITY_NAMES = {
    0: "unresp",
    1: "ignored",
    2: "Corporate",
    3: "Confidential Data Storage",
    4: "Cyprus Creek Campus",
    5: "Other",
}

ENDPOINTS = ("source", "destination")
# The four port-count series of a host. No suffix: sessions the host opened; "_inc": sessions it received.
SERIES = ("source", "destination", "source_inc", "destination_inc")

SHARE_FEATURES = tuple(f"featuresfracq{q}" for q in range(4))
SPREAD_FEATURES = ("featuresvar", "featuresabvavg") + tuple(f"featuresabvavg{k}s" for k in (1, 2, 3))
TOP_PORTS = 5

STATISTICS_FEATURES = (
    tuple(f"{e}_{m}_{s}" for e in ENDPOINTS for m in ("bytes", "packets") for s in ("mean", "var"))
    + tuple(f"network_bytes_{s}{d}" for d in ("", "_inc") for s in ("mean", "var"))
    + ("duration_mean", "duration_var", "sessions", "sessions_inc")
)
PROTOCOL_FEATURES = ("ipProtocol_unique",) + tuple(
    f"ipProtocol_{s}{d}" for d in ("", "_inc") for s in ("mode", "minor_fraction")
)
COARSE_PORT_FEATURES = tuple(
    f"{e}_port_{s}"
    for e in ENDPOINTS
    for s in (
        "system_unique",
        "system_std",
        "system_most_count",
        "user_unique",
        "user_std",
        "user_most_count",
        "dynamic",
    )
) + ("host_lt_other",)
FINE_PORT_FEATURES = (
    ("port_intext_ratio", "port_intext_ratio_inc")
    + tuple(f"{s}_{f}" for s in SERIES for f in SHARE_FEATURES + SPREAD_FEATURES)
    + tuple(f"{s}_top5_{k}" for s in SERIES for k in range(1, TOP_PORTS + 1))
)

# Nested feature sets of 16, 21, 36 and 94 columns.
FEATURE_GROUPS = {
    "statistics": STATISTICS_FEATURES,
    "protocol": STATISTICS_FEATURES + PROTOCOL_FEATURES,
    "coarse": STATISTICS_FEATURES + PROTOCOL_FEATURES + COARSE_PORT_FEATURES,
    "all": STATISTICS_FEATURES + PROTOCOL_FEATURES + COARSE_PORT_FEATURES + FINE_PORT_FEATURES,
}
FEATURES = FEATURE_GROUPS["all"]
