"""Port and protocol counts per host, and the distribution features built on them.

Everything starts from one table with a row per (host, kind, value): ``kind`` is port or protocol,
``value`` the port number or protocol code. Counting there first turns a host with a third of all
sessions into at most 65,537 + 256 rows, spread over tasks by value; only those rows meet in one
task later. No distinct aggregate is ever needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.numbers import ratio
from hostloom.schema import SERIES, SHARE_FEATURES, SPREAD_FEATURES, TOP_PORTS

EXACT = "decimal(38,0)"
SYSTEM_PORTS_END = 1024
DYNAMIC_PORTS_START = 49151

# A session is counted once per (end, port) pair. Codes 0-3 follow SERIES; 4 and 5 count its protocol.
_CODES = {"source": 0, "destination": 1, "source_inc": 2, "destination_inc": 3}
_PROTOCOL, _PROTOCOL_INC = 4, 5


def value_counts(sessions: DataFrame, keys: Sequence[str] = (), ports: bool = True, protocols: bool = True) -> DataFrame:
    """Counts per (keys, ip, kind, value).

    ``n_<series>`` counts sessions; ``b_source`` and ``b_source_inc`` count those with a byte count, which
    the host opened / received. For protocols only the ``source`` and ``source_inc`` counters are used.
    """
    codes = list(_CODES.values()) * ports + [_PROTOCOL, _PROTOCOL_INC] * protocols
    code = F.col("code")
    rows = sessions.select("*", F.explode(F.array(*[F.lit(c) for c in codes])).alias("code")).select(
        *keys,
        F.when(code.isin(0, 1, _PROTOCOL), F.col("source_ip")).otherwise(F.col("destination_ip")).alias("ip"),
        (code < _PROTOCOL).alias("is_port"),
        F.when(code.isin(0, 2), F.col("source_port"))
        .when(code.isin(1, 3), F.col("destination_port"))
        .otherwise(F.col("ip_protocol"))
        .alias("value"),
        code,
        F.col("source_bytes").isNotNull().alias("has_bytes"),
    )
    counters = []
    for series, number in _CODES.items():
        counted = code == number
        if series == "source":
            counted = counted | (code == _PROTOCOL)
        if series == "source_inc":
            counted = counted | (code == _PROTOCOL_INC)
        counters.append(F.count_if(counted).alias(f"n_{series}"))
        if series in ("source", "source_inc"):
            counters.append(F.count_if(counted & F.col("has_bytes")).alias(f"b_{series}"))
    return rows.groupBy(*keys, "ip", "is_port", "value").agg(*counters)


def gathered(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One exchange on the host key; every later aggregate, window and join on it stays in place.

    All consumers in this module read every column of ``counts`` and filter only behind the exchange, so
    that several of them in one plan have the same input and Spark runs it once (reused exchange).
    """
    return counts.repartition(*[F.col(c) for c in (*keys, "ip")])


def port_series(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long form: (keys, ip, series, port, cnt, with_bytes), one row per port a host was seen with."""
    nothing = F.lit(0).cast("bigint")
    entries = []
    for series in SERIES:
        # A filter on is_port would move below the exchange; a zero count is dropped here instead.
        cnt = F.when(F.col("is_port"), F.col(f"n_{series}")).otherwise(nothing)
        with_bytes = F.col(f"b_{series}") if series in ("source", "source_inc") else nothing
        entries.append(F.struct(F.lit(series).alias("series"), cnt.alias("cnt"), with_bytes.alias("with_bytes")))
    long = counts.select(*keys, "ip", F.col("value").alias("port"), F.inline(F.array(*entries)))
    return long.filter("cnt > 0")


def port_value_counts(sessions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per host and series the list of (cnt, port), count descending, lowest port first among equals.

    A list has at most 65,537 entries: one per port and one for sessions without a port.
    """
    series = port_series(gathered(value_counts(sessions, keys, protocols=False), keys), keys)
    entry = F.struct((-F.col("cnt")).alias("neg"), F.col("port"))
    ordered = F.array_sort(F.collect_list(entry))
    return series.groupBy(*keys, "ip", "series").agg(
        F.transform(ordered, lambda e: F.struct(e["port"].alias("port"), (-e["neg"]).alias("cnt"))).alias("port_counts")
    )


def _by_series(long: DataFrame, keys: Sequence[str], values: dict[str, Column], default) -> DataFrame:
    """One row per host: ``<series>_<value>`` columns, ``default(value)`` where a host has no such series."""
    columns = []
    for series in SERIES:
        here = F.col("series") == series
        for name, value in values.items():
            columns.append(F.coalesce(F.max(F.when(here, value)), F.lit(default(name))).alias(f"{series}_{name}"))
    return long.groupBy(*keys, "ip").agg(*columns)


def count_distribution(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shares and spread of the per-port counts of every (keys, ip, series).

    Ports with the same count behave alike in all nine features, so they are first merged into
    (count, number of ports) rows; the windows run over these few rows instead of over all ports.
    The limits ``count > mean + k std`` are compared in exact integers: with n ports, S the sum of
    the counts and Q the sum of their squares, ``n c > S`` and ``(n c - S)^2 > k^2 (n Q - S^2)``.
    """
    group = [*keys, "ip", "series"]
    # Counting by port keeps the port column in the plan, and with it the exchange shared with top_ports.
    ports_seen = F.count("port") + F.count_if(F.col("port").isNull())
    merged = series.groupBy(*group, "cnt").agg(ports_seen.alias("ports"), F.sum("with_bytes").alias("with_bytes"))
    whole = Window.partitionBy(*group)
    running = whole.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cnt = F.col("cnt").cast(EXACT)
    ports = F.col("ports").cast(EXACT)
    host = Window.partitionBy(*keys, "ip")

    def sessions_of(series: str) -> Column:
        return F.sum(F.when(F.col("series") == series, F.col("with_bytes")).otherwise(0)).over(host)

    received = F.col("series").isin("source_inc", "destination_inc")
    placed = merged.select(
        *group,
        "cnt",
        "ports",
        F.sum(F.col("cnt") * F.col("ports")).over(running).alias("cum"),
        F.when(received, sessions_of("source_inc")).otherwise(sessions_of("source")).alias("total"),
        F.sum("ports").over(whole).cast(EXACT).alias("n"),
        F.sum(F.col("cnt") * F.col("ports")).over(whole).cast(EXACT).alias("s"),
        F.sum((cnt * cnt * ports).cast(EXACT)).over(whole).cast(EXACT).alias("q"),
    )
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast(EXACT)
    excess = (F.col("n") * F.col("cnt").cast(EXACT) - F.col("s")).cast(EXACT)
    placed = placed.withColumns({"spread": spread, "excess": excess})

    def share(quarter: int) -> Column:
        # Counts descend, so the largest count beyond the quarter is the first one to pass it.
        return F.max(F.when(F.col("cum") * 4 > F.col("total") * quarter, F.col("cnt"))) / F.max("total")

    def above(k: int) -> Column:
        beyond = F.col("excess") > 0
        if k:
            beyond = beyond & (F.col("excess") * F.col("excess") > F.col("spread") * F.lit(k * k).cast(EXACT))
        return F.coalesce(F.sum(F.when(beyond, F.col("ports"))), F.lit(0))

    variance = F.max("spread").cast("double") / F.max(F.col("n") * F.col("n")).cast("double")
    columns = {name: share(q) for q, name in enumerate(SHARE_FEATURES)}
    columns |= dict(zip(SPREAD_FEATURES, [variance] + [above(k) for k in range(4)]))
    enough = F.max("total") > 1
    return placed.groupBy(*group).agg(
        *[F.when(enough, c).otherwise(_distribution_default(n)).alias(n) for n, c in columns.items()]
    )


def _distribution_default(name: str) -> float | int:
    if name in SHARE_FEATURES:
        return 1.0
    return 0.0 if name == "featuresvar" else 0


def _distribution_columns(series: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    values = {n: F.col(n) for n in names}
    return _by_series(count_distribution(series, keys), keys, values, _distribution_default)


def quartile_shares(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of sessions on the port at which the running share passes 0, 1/4, 1/2 and 3/4."""
    return _distribution_columns(series, keys, SHARE_FEATURES)


def count_spread(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Population variance of the per-port counts, and the number of ports above mean + k std."""
    return _distribution_columns(series, keys, SPREAD_FEATURES)


def top_ports(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The five commonest ports of each series, 0 where there are fewer (or the port is missing)."""
    group = [*keys, "ip", "series"]
    order = Window.partitionBy(*group).orderBy(F.desc("cnt"), F.asc_nulls_first("port"))
    ranked = series.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TOP_PORTS)
    port = F.coalesce(F.col("port"), F.lit(0))
    values = {f"top5_{k}": F.when(F.col("place") == k, port) for k in range(1, TOP_PORTS + 1)}
    return _by_series(ranked, keys, values, lambda _: 0)


def port_distribution(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All 56 columns: shares, spread and top ports for both endpoints and both directions."""
    shapes = _distribution_columns(series, keys, SHARE_FEATURES + SPREAD_FEATURES)
    return shapes.join(top_ports(series, keys), [*keys, "ip"], "left")


def port_bands(port: Column, user_band: str) -> dict[str, Column]:
    """Band tests on a port. ``as_written`` takes every port as a user port, ``intended`` 1024-49150."""
    if user_band not in ("as_written", "intended"):
        raise ValueError(f"user_band: {user_band}")
    user = port.isNotNull()
    if user_band == "intended":
        user = (port >= SYSTEM_PORTS_END) & (port < DYNAMIC_PORTS_START)
    return {"system": port < SYSTEM_PORTS_END, "user": user}


def coarse_port_aggregates(user_band: str) -> list[Column]:
    """Distinct ports and busiest port per band, and dynamic-port sessions, for own and far end."""
    own = F.col("n_source") + F.col("n_destination_inc")
    far = F.col("n_destination") + F.col("n_source_inc")
    columns = []
    for end, count in (("source", own), ("destination", far)):
        for band, inside in port_bands(F.col("value"), user_band).items():
            used = F.col("is_port") & inside & (count > 0)
            columns.append(F.count_if(used).alias(f"{end}_port_{band}_unique"))
            columns.append(F.coalesce(F.max(F.when(used, count)), F.lit(0)).alias(f"{end}_port_{band}_most_count"))
        dynamic = F.col("is_port") & (F.col("value") >= DYNAMIC_PORTS_START)
        columns.append(F.coalesce(F.sum(F.when(dynamic, count)), F.lit(0)).alias(f"{end}_port_dynamic"))
    return columns


def protocol_aggregates() -> list[Column]:
    """Distinct protocols of a host and sessions on its commonest one, both directions together."""
    count = F.when(~F.col("is_port") & F.col("value").isNotNull(), F.col("n_source") + F.col("n_source_inc"))
    return [
        F.count(count).alias("ipProtocol_unique"),
        F.coalesce(F.max(count), F.lit(0)).alias("ipProtocol_most_count"),
    ]


def directed_aggregates() -> list[Column]:
    """Per direction: sessions, commonest protocol, share of sessions off it, ratio of distinct ports."""
    columns = []
    for suffix in ("", "_inc"):
        count = F.col(f"n_source{suffix}")
        with_bytes = F.when(~F.col("is_port"), F.col(f"b_source{suffix}")).otherwise(0)
        columns.append(F.sum(with_bytes).alias(f"sessions{suffix}"))
        used = ~F.col("is_port") & F.col("value").isNotNull() & (count > 0)
        # Highest count first, then lowest code: one number orders both, whatever the code.
        order = F.when(used, count.cast(EXACT) * F.lit(str(2**64)).cast(EXACT) - F.col("value").cast(EXACT))
        mode = F.max_by("value", order.cast(EXACT))
        total = F.sum(F.when(used, count))
        columns.append(F.coalesce(mode, F.lit(0)).alias(f"ipProtocol_mode{suffix}"))
        columns.append(ratio(total - F.max(F.when(used, count)), total).alias(f"ipProtocol_minor_fraction{suffix}"))
        seen = [
            F.count_if(F.col("is_port") & F.col("value").isNotNull() & (F.col(f"n_{end}{suffix}") > 0))
            for end in ("source", "destination")
        ]
        columns.append(ratio(*seen).alias(f"port_intext_ratio{suffix}"))
    return columns


def aggregate_counts(counts: DataFrame, keys: Sequence[str], *groups: Sequence[Column]) -> DataFrame:
    return counts.groupBy(*keys, "ip").agg(*[column for group in groups for column in group])
