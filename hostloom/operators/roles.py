"""Host totals and what they say about a host: role, facility class, address kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.functions.addresses import is_ipv4, is_public
from hostloom.functions.labels import facility_code, is_blue, is_ghost, is_ignored, role_code
from hostloom.functions.ranges import IpRanges, is_public_by

TOTALS = ("source_bytes", "destination_bytes", "network_bytes")


def host_totals(sessions: DataFrame) -> DataFrame:
    """Byte totals per host, as source and (``_dst``) as destination; 0 where a host never had the role.

    One scan and one shuffle of partial sums: both roles of a session go into the same aggregate.
    """
    ends = sessions.select(
        *TOTALS,
        "source_ip",
        "destination_ip",
        F.explode(F.array(F.lit(False), F.lit(True))).alias("received"),
    )
    rows = ends.select(
        F.when(F.col("received"), F.col("destination_ip")).otherwise(F.col("source_ip")).alias("ip"), "received", *TOTALS
    ).filter(F.col("ip").isNotNull())
    sums = [F.coalesce(F.sum(F.when(~F.col("received"), F.col(c))), F.lit(0)).alias(c) for c in TOTALS]
    sums += [F.coalesce(F.sum(F.when(F.col("received"), F.col(c))), F.lit(0)).alias(f"{c}_dst") for c in TOTALS]
    return rows.groupBy("ip").agg(*sums)


def hosts(sessions: DataFrame) -> DataFrame:
    """Every address seen at either end of a session."""
    ends = sessions.select(F.explode(F.array("source_ip", "destination_ip")).alias("ip"))
    return ends.filter(F.col("ip").isNotNull()).distinct()


def ghost_hosts(totals: DataFrame) -> DataFrame:
    return totals.filter(is_ghost())


def ignored_hosts(totals: DataFrame) -> DataFrame:
    return totals.filter(is_ignored())


def real_hosts(totals: DataFrame) -> DataFrame:
    return totals.filter(~(is_ghost() | is_ignored()))


def _hosts_that(sessions: DataFrame, test: Column) -> DataFrame:
    """Hosts whose ``ip`` passes a costly test. The condition holds a count, so it stays behind the grouping: an address is
    tested once, not once per session."""
    ends = sessions.select(F.explode(F.array("source_ip", "destination_ip")).alias("ip"))
    seen = ends.filter(F.col("ip").isNotNull()).groupBy("ip").agg(F.count("*").alias("n"))
    return seen.filter(F.when(F.col("n") > 0, test)).select("ip")


def public_ips(sessions: DataFrame, ranges: IpRanges | None = None) -> DataFrame:
    """Globally routable hosts, by the built-in test or by a range table."""
    ip = F.col("ip")
    return _hosts_that(sessions, is_public(ip) if ranges is None else is_public_by(ip, ranges))


def ipv4_hosts(sessions: DataFrame) -> DataFrame:
    return _hosts_that(sessions, is_ipv4(F.col("ip")))


def labelled_hosts(sessions: DataFrame) -> DataFrame:
    """Hosts that get a label: IPv4 and not globally routable."""
    return _hosts_that(sessions, is_ipv4(F.col("ip")) & ~is_public(F.col("ip")))


def host_roles(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """Inventory rows of internal IPv4 hosts with ``blue_team_bool`` and ``red_vs_blue`` (0-4).

    The inventory is as large as the network, so it is joined on ``ip`` without a broadcast hint.
    """
    kept = labels.filter(is_ipv4(F.col("ip")) & ~is_public(F.col("ip")))
    states = host_totals(sessions).select("ip", is_ghost().alias("ghost"), is_ignored().alias("ignored"))
    joined = kept.join(states, "ip", "left").withColumn("blue_team_bool", is_blue(F.col("blue_team")))
    role = role_code(F.col("ghost"), F.col("ignored"), F.col("red_team"), F.col("blue_team_bool"))
    return joined.withColumn("red_vs_blue", role).drop("ghost", "ignored")


def facility_classes(roles: DataFrame) -> DataFrame:
    """Adds ``facility_class`` (0-5)."""
    return roles.withColumn("facility_class", facility_code(F.col("red_vs_blue"), F.col("facility")))


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def facility_list(labels: DataFrame) -> DataFrame:
    return labels.select("facility").distinct()


def facility_hostnames(labels: DataFrame, facility: str) -> DataFrame:
    return labels.filter(F.col("facility") == facility).select("hostname").distinct()
