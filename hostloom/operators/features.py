"""Host feature sets.

Every function takes ``keys``, further grouping columns next to ``ip``: none for the whole period,
``("slice",)`` for one row per slice and host. A full feature table needs two scans of the internal
sessions: one for moments (means, variances) and one for port and protocol counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.addresses import octet
from hostloom.functions.numbers import filled, ratio
from hostloom.operators import ports
from hostloom.operators.sessions import internal_sessions, mirror_sessions
from hostloom.schema import ENDPOINTS, FEATURE_GROUPS, FEATURES

OCTETS = tuple(f"ip_octet_byte_{i}" for i in range(1, 5))
NODE_MEASURES = ("duration", "source_bytes", "destination_bytes", "source_packets", "destination_packets")
EDGE_MEASURES = ("duration", "destination_bytes", "destination_packets")

# Columns touched by the optional scalings.
SESSION_SCALED = tuple(
    f"{e}_port_{s}"
    for e in ENDPOINTS
    for s in ("system_unique", "system_most_count", "user_unique", "user_most_count", "dynamic")
) + ("ipProtocol_unique", "ipProtocol_most_count")
MINMAX_SCALED = tuple(f"{e}_port_{b}_std" for e in ENDPOINTS for b in ("system", "user"))


def _octet_means() -> list[Column]:
    return [filled(F.avg(octet(F.col("other_ip"), i)) / 255).alias(n) for i, n in enumerate(OCTETS, 1)]


def _byte_means() -> list[Column]:
    return [filled(F.avg(f"{e}_bytes")).alias(f"{e}_bytes_mean") for e in ENDPOINTS]


def _port_deviations(user_band: str) -> list[Column]:
    """Sample deviation of the port numbers per band, and sessions with own port below far port."""
    columns = []
    for end in ENDPOINTS:
        port = F.col(f"{end}_port")
        for band, inside in ports.port_bands(port, user_band).items():
            columns.append(filled(F.stddev_samp(F.when(inside, port))).alias(f"{end}_port_{band}_std"))
    columns.append(F.count_if(F.col("source_port") < F.col("destination_port")).alias("host_lt_other"))
    return columns


def _moments(measures: Sequence[str]) -> list[Column]:
    columns = []
    for m in measures:
        columns.append(filled(F.avg(m)).alias(f"{m}_mean"))
        columns.append(filled(F.var_samp(m)).alias(f"{m}_var"))
    return columns


def _directed_moments() -> list[Column]:
    """Network byte moments, as source and (``_inc``) as destination."""
    columns = []
    for suffix, here in (("", ~F.col("received")), ("_inc", F.col("received"))):
        network = F.when(here, F.col("network_bytes"))
        columns.append(filled(F.avg(network)).alias(f"network_bytes_mean{suffix}"))
        columns.append(filled(F.var_samp(network)).alias(f"network_bytes_var{suffix}"))
    return columns


def ip_octet_means(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each dotted part of the far addresses, divided by 255; other address forms are skipped."""
    return mirror_sessions(internal_sessions(sessions), *keys).groupBy(*keys, "ip").agg(*_octet_means())


def li_features(
    sessions: DataFrame, keys: Sequence[str] = (), user_band: str = "as_written", scale: str | None = None
) -> DataFrame:
    """Port bands, byte means, protocol counts and far-address octets over mirrored sessions.

    ``scale="sessions"`` divides the twelve counts by the host's sessions; ``scale="minmax"`` maps the
    four port deviations to [0, 1] over all hosts. The default is neither.
    """
    if scale not in (None, "sessions", "minmax"):
        raise ValueError(f"scale: {scale}")
    internal = internal_sessions(sessions)
    by = [*keys, "ip"]
    moments = (
        mirror_sessions(internal, *keys)
        .groupBy(*by)
        .agg(F.count("source_bytes").alias("sessions"), *_byte_means(), *_octet_means(), *_port_deviations(user_band))
    )
    counts = ports.aggregate_counts(
        ports.value_counts(internal, keys), keys, ports.coarse_port_aggregates(user_band), ports.protocol_aggregates()
    )
    if scale == "minmax":
        moments = _minmax(moments, MINMAX_SCALED)
    features = moments.join(counts, by)
    if scale == "sessions":
        features = features.withColumns({c: ratio(F.col(c), F.col("sessions")) for c in SESSION_SCALED})
    return features.drop("sessions")


def _minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c - min) / (max - min) over all rows; the bounds are one row, read first. 0 where all are equal."""
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        scaled[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0)
    return df.withColumns(scaled)


def pro_node_features(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and sample variance of duration, bytes and packets over mirrored sessions."""
    mirrored = mirror_sessions(internal_sessions(sessions), *keys)
    return mirrored.groupBy(*keys, "ip").agg(*_moments(NODE_MEASURES))


def pro_edge_features(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means per (host, far host)."""
    mirrored = mirror_sessions(internal_sessions(sessions), *keys)
    return mirrored.groupBy(*keys, "ip", "other_ip").agg(
        *[filled(F.avg(m)).alias(f"{m}_mean") for m in EDGE_MEASURES]
    )


def lyu_features(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Directed features: sessions opened and (``_inc``) sessions received, side by side.

    Both directions go through one aggregate, which gives what a full join of a by-source and a
    by-destination aggregate gives, without the join. The port lists are ``ports.port_value_counts``.
    """
    internal = internal_sessions(sessions)
    moments = mirror_sessions(internal, *keys).groupBy(*keys, "ip").agg(*_directed_moments())
    counts = ports.aggregate_counts(ports.value_counts(internal, keys), keys, ports.directed_aggregates())
    return moments.join(counts, [*keys, "ip"])


def host_features(
    sessions: DataFrame, keys: Sequence[str] = (), user_band: str = "as_written", only: DataFrame | None = None
) -> DataFrame:
    """The 94 features per (keys, ip); ``only`` lists the (keys, ip) to compute, which drop out before the windows."""
    internal = internal_sessions(sessions)
    by = [*keys, "ip"]
    moments = (
        mirror_sessions(internal, *keys)
        .groupBy(*by)
        .agg(*_moments(NODE_MEASURES), *_directed_moments(), *_port_deviations(user_band))
    )
    counts = ports.value_counts(internal, keys)
    if only is not None:
        moments, counts = (table.join(only.select(*by), by, "left_semi") for table in (moments, counts))
    return count_features(moments, counts, keys, user_band).select(*by, *FEATURES)


def count_features(
    moments: DataFrame, counts: DataFrame, keys: Sequence[str] = (), user_band: str = "as_written"
) -> DataFrame:
    """``moments`` (one row per (keys, ip)) with all features that follow from the counts of the same sessions."""
    by = [*keys, "ip"]
    counts = ports.gathered(counts, keys)
    coarse = ports.aggregate_counts(
        counts,
        keys,
        ports.coarse_port_aggregates(user_band),
        ports.protocol_aggregates(),
        ports.directed_aggregates(),
    )
    fine = ports.port_distribution(ports.port_series(counts, keys), keys)
    # All three tables hold the same hosts: every session feeds each of them.
    return moments.join(coarse, by, "left").join(fine, by, "left")


def select_group(features: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """One of the nested feature sets: statistics (16), protocol (21), coarse (36), all (94)."""
    return features.select(*keys, "ip", *FEATURE_GROUPS[group])


def sessions_per_hour(features: DataFrame, hours: float) -> DataFrame:
    """Session counts per observed hour."""
    return features.withColumns({c: F.col(c) / F.lit(hours) for c in ("sessions", "sessions_inc")})


def labelled(features: DataFrame, labels: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Feature rows of labelled hosts with their label. Both sides are host tables: no hint."""
    return features.join(labels.select(*keys, "ip", label), [*keys, "ip"])


def class_subset(df: DataFrame, label: str, names: dict[int, str]) -> DataFrame:
    """Rows of the classes in ``names``, with the class name as ``class_name``."""
    code = F.col(label)
    name = F.lit(None).cast("string")
    for value, text in names.items():
        name = F.when(code == value, text).otherwise(name)
    return df.filter(code.isin(*names)).withColumn("class_name", name)
