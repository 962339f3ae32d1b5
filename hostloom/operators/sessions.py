"""Session rows: cleaning, filters, mirroring.

All of it is row-local (no shuffle). The one exception is an explicit address list, see
``internal_sessions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.addresses import is_ipv6, is_public, is_public_v4
from hostloom.functions.ranges import IpRanges, is_public_by


def duration() -> Column:
    return F.col("last_packet") - F.col("first_packet")


def clean_sessions(sessions: DataFrame, provider: str = "arkime", dropped_protocol: str = "lldp") -> DataFrame:
    """Rows of one log provider without link-layer discovery; a null in either column drops the row."""
    return sessions.filter(F.col("event_provider").contains(provider) & ~F.col("protocol").contains(dropped_protocol))


def internal_sessions(
    sessions: DataFrame, public_ips: DataFrame | None = None, ranges: IpRanges | None = None
) -> DataFrame:
    """Sessions between internal hosts whose source is not IPv6 (the destination may be).

    By default the routability test itself is the filter, evaluated in the scan stage; ``ranges`` puts a range table in
    place of the built-in one. Pass
    ``public_ips`` (column ``ip``) to deny exactly a given list instead. That list is not hinted:
    Spark broadcasts it if it is below its broadcast threshold and shuffles otherwise, where adaptive
    execution splits hot addresses.
    """
    known = sessions.filter(
        F.col("source_ip").isNotNull() & F.col("destination_ip").isNotNull() & ~is_ipv6(F.col("source_ip"))
    )
    if public_ips is not None and ranges is not None:
        raise ValueError("either a list or ranges")
    if ranges is not None:
        return known.filter(~is_public_by(F.col("source_ip"), ranges) & ~is_public_by(F.col("destination_ip"), ranges))
    if public_ips is None:
        return known.filter(~is_public_v4(F.col("source_ip")) & ~is_public(F.col("destination_ip")))
    listed = public_ips.select(F.col("ip").alias("listed_ip")).filter(F.col("listed_ip").isNotNull()).distinct()
    for end in ("source_ip", "destination_ip"):
        known = known.join(listed, known[end] == listed["listed_ip"], "left_anti")
    return known


def session_duration(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("duration", duration())


def mirror_sessions(sessions: DataFrame, *keys: str) -> DataFrame:
    """Each session twice, once per end: the host as ``ip``, the far end as ``other_ip``.

    ``source_*`` becomes the host's own end and ``destination_*`` the far end; ``received`` is true
    on the row of the session's destination. A self-session counts twice. Only a boolean is
    generated per session, so columns a query does not use are never read, and the log is scanned once.
    """
    both = sessions.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("received"))

    def end(own: str, far: str) -> Column:
        return F.when(F.col("received"), F.col(far)).otherwise(F.col(own))

    pairs = []
    for measure in ("port", "bytes", "packets"):
        s, d = f"source_{measure}", f"destination_{measure}"
        pairs += [end(s, d).alias(s), end(d, s).alias(d)]
    return both.select(
        *keys,
        "received",
        end("source_ip", "destination_ip").alias("ip"),
        end("destination_ip", "source_ip").alias("other_ip"),
        *pairs,
        "network_bytes",
        "ip_protocol",
        duration().alias("duration"),
    )


def host_sessions(sessions: DataFrame, ip: str) -> DataFrame:
    """All sessions from or to one host, with its ``role`` in each; a self-session appears in both roles."""
    ends = sessions.select("*", F.explode(F.array(F.lit("source"), F.lit("destination"))).alias("role"))
    matched = ((F.col("role") == "source") & (F.col("source_ip") == ip)) | (
        (F.col("role") == "destination") & (F.col("destination_ip") == ip)
    )
    return ends.filter((F.col("source_ip") == ip) | (F.col("destination_ip") == ip)).filter(matched)


def answered_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions in which the far end sent something back."""
    return sessions.filter(F.col("destination_bytes") > 0)


def in_subnet(hosts: DataFrame, prefix: str, column: str = "ip") -> DataFrame:
    """Rows whose address starts with a dotted prefix such as ``10.20.20.``."""
    return hosts.filter(F.col(column).startswith(prefix))


def select_hosts(hosts: DataFrame, *ips: str) -> DataFrame:
    """All rows of the named hosts."""
    return hosts.filter(F.col("ip").isin(*ips))
