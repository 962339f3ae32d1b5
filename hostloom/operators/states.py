"""Mergeable host states: features of any stretch of time from stored partial results.

A state is two tables with a row per (part, slice, host): moments (n, mean, M2 of every measure) and counts per port and
protocol. A part is what is loaded at once, usually a day. The period, a set of slices or a period with one more day are
roll-ups of states: moments merge by Chan's rule, counts add up. A new day is one more folder and reads that day's
sessions only. Sessions outside all slices have a null slice; they count for the period and for no slice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostloom.functions.numbers import filled
from hostloom.operators import ports
from hostloom.operators.features import NODE_MEASURES, count_features
from hostloom.operators.sessions import internal_sessions, mirror_sessions
from hostloom.operators.slices import SliceLayout, name_slices, number_slices
from hostloom.schema import ENDPOINTS, FEATURES, SERIES

KEYS = ("slice", "slice_no")
COUNTERS = tuple(f"n_{s}" for s in SERIES) + ("b_source", "b_source_inc")


@dataclass(frozen=True)
class HostStates:
    """``moments``: (keys, ip, one struct per measure, host_lt_other); ``counts``: ``ports.value_counts`` per keys."""

    moments: DataFrame
    counts: DataFrame
    user_band: str = "as_written"

    def filter(self, condition: Column | str) -> HostStates:
        """States of some slices or parts; the condition may use the key columns only."""
        return HostStates(self.moments.filter(condition), self.counts.filter(condition), self.user_band)


def _measures(user_band: str) -> dict[str, Column]:
    """What moments are kept of, over mirrored sessions."""
    measures = {m: F.col(m) for m in NODE_MEASURES}
    measures["network_bytes"] = F.when(~F.col("received"), F.col("network_bytes"))
    measures["network_bytes_inc"] = F.when(F.col("received"), F.col("network_bytes"))
    for end in ENDPOINTS:
        port = F.col(f"{end}_port")
        for band, inside in ports.port_bands(port, user_band).items():
            measures[f"{end}_port_{band}"] = F.when(inside, port)
    return measures


def _state(value: Column) -> Column:
    """n, mean and M2 (sum of squared distances from the mean); 0 for no values."""
    n = F.count(value)
    return F.struct(n.alias("n"), filled(F.avg(value)).alias("mean"), filled(F.var_pop(value) * n).alias("m2"))


def host_states(sessions: DataFrame, keys: Sequence[str] = KEYS, user_band: str = "as_written") -> HostStates:
    """States per (keys, ip) of internal sessions; two scans. The port band is fixed here, as deviations depend on it."""
    internal = internal_sessions(sessions)
    measures = _measures(user_band)
    below = F.count_if(F.col("source_port") < F.col("destination_port")).alias("host_lt_other")
    moments = (
        mirror_sessions(internal, *keys)
        .groupBy(*keys, "ip")
        .agg(*[_state(value).alias(name) for name, value in measures.items()], below)
    )
    return HostStates(moments, ports.value_counts(internal, keys), user_band)


def _state_keys(moments: DataFrame) -> list[str]:
    return [name for name, kind in moments.dtypes if not kind.startswith("struct") and name not in ("ip", "host_lt_other")]


def _single_states(moments: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no two states of a host share ``keys``: each of their values occurs with one part and slice only."""
    met = moments.select(*_state_keys(moments)).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    return (met.agg(F.max("n")).first()[0] or 0) <= 1


def merged(states: HostStates, keys: Sequence[str] = ()) -> HostStates:
    """States per (keys, ip): all other key columns are rolled up.

    Of a group of states with counts n_i and means m_i, the mean is sum(n_i m_i) / sum(n_i), and M2 is the sum of the
    M2_i and of n_i (m_i - mean)^2. The mean is a window over the group, the sums run on the partitioning it leaves; a
    host has one state per part and slice, so a group is small even for a host with a third of all sessions.
    Where every value of ``keys`` lies in one part and slice, which one row tells, the states are those asked for already.
    """
    by = [*keys, "ip"]
    if keys and _single_states(states.moments, keys):
        beside = [c for c in _state_keys(states.moments) if c not in keys]
        return HostStates(states.moments.drop(*beside), states.counts.drop(*beside), states.user_band)
    names = [name for name, kind in states.moments.dtypes if kind.startswith("struct")]
    group = Window.partitionBy(*by)
    columns, sums = [], []
    for name in names:
        n, mean, m2 = (F.col(f"{name}.{part}") for part in ("n", "mean", "m2"))
        common = filled(F.sum(n * mean).over(group) / F.nullif(F.sum(n).over(group), F.lit(0)))
        columns.append(F.struct(n.alias("n"), common.alias("mean"), (m2 + n * (mean - common) ** 2).alias("m2")).alias(name))
        # The mean is the same in all rows of a group.
        sums.append(F.struct(F.sum(n).alias("n"), F.max(mean).alias("mean"), F.sum(m2).alias("m2")).alias(name))
    spread = states.moments.select(*by, "host_lt_other", *columns)
    moments = spread.groupBy(*by).agg(*sums, F.sum("host_lt_other").alias("host_lt_other"))
    counts = states.counts.groupBy(*by, "is_port", "value").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return HostStates(moments, counts, states.user_band)


def _moment_features(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    def sample_variance(name: str) -> Column:
        n, m2 = F.col(f"{name}.n"), F.col(f"{name}.m2")
        return F.when(n > 1, m2 / (n - 1)).otherwise(0.0)

    columns = [F.col("host_lt_other")]
    for m in NODE_MEASURES:
        columns += [F.col(f"{m}.mean").alias(f"{m}_mean"), sample_variance(m).alias(f"{m}_var")]
    for suffix in ("", "_inc"):
        name = f"network_bytes{suffix}"
        columns.append(F.col(f"{name}.mean").alias(f"network_bytes_mean{suffix}"))
        columns.append(sample_variance(name).alias(f"network_bytes_var{suffix}"))
    for end in ENDPOINTS:
        for band in ("system", "user"):
            name = f"{end}_port_{band}"
            columns.append(F.sqrt(sample_variance(name)).alias(f"{name}_std"))
    return moments.select(*keys, "ip", *columns)


def state_features(states: HostStates, keys: Sequence[str] = ()) -> DataFrame:
    """The 94 features per (keys, ip), as ``features.host_features`` gives them from the sessions.

    Rows with a null among ``keys`` are left out: they are sessions outside all slices.
    """
    for key in keys:
        states = states.filter(F.col(key).isNotNull())
    by = [*keys, "ip"]
    rolled = merged(states, keys)
    moments = _moment_features(rolled.moments, keys)
    return count_features(moments, rolled.counts, keys, states.user_band).select(*by, *FEATURES)


def add_part(sessions: DataFrame, layout: SliceLayout, path: str, part: str, user_band: str = "as_written") -> None:
    """Store the states of one load: ``<path>/<user_band>/moments/part=<part>`` and the same below ``counts``.

    A part that is there already is an error; its sessions would count twice. Counts are written first: a load that
    failed before its end has no complete moments, is not read, and may be repeated. Slices should be named alike in all
    parts that share them: equal names are rolled up together.
    """
    if part in stored_parts(sessions.sparkSession, path, user_band):
        raise ValueError(f"part {part} is stored already")
    # The number alone is shuffled; its name follows from it.
    states = host_states(number_slices(sessions, layout), ("slice_no",), user_band)
    for table in ("counts", "moments"):
        name_slices(getattr(states, table), layout).write.mode("overwrite").parquet(f"{path}/{user_band}/{table}/part={part}")


def stored_parts(spark: SparkSession, path: str, user_band: str = "as_written") -> list[str]:
    """Names of the complete parts of one port band below ``path``, sorted."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{user_band}/moments")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders = [status.getPath() for status in files.listStatus(root)]
    done = [f for f in folders if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(f.getName().removeprefix("part=") for f in done)


def read_states(spark: SparkSession, path: str, *parts: str, user_band: str = "as_written") -> HostStates:
    """The stored states of ``parts`` (all complete ones, if none is named), with the column ``part``."""
    known = stored_parts(spark, path, user_band)
    unknown = set(parts) - set(known)
    if unknown or not known:
        raise ValueError(f"no stored part {', '.join(sorted(unknown)) or 'at all'} in {path}")
    tables = []
    for table in ("moments", "counts"):
        base = f"{path}/{user_band}/{table}"
        rows = spark.read.option("basePath", base).parquet(*[f"{base}/part={p}" for p in (parts or known)])
        tables.append(rows.withColumn("part", F.col("part").cast("string")))
    return HostStates(*tables, user_band)
