import ipaddress
import math
import random

import brute
import pytest
from pyspark.sql import functions as F

from hostloom.operators import features as X
from hostloom.operators import ports as P
from hostloom.operators import sessions as S
from hostloom.schema import COARSE_PORT_FEATURES, FEATURE_GROUPS, FEATURES, SESSION_SCHEMA

HUB = "10.0.0.1"


def session(source="10.0.0.2", destination="10.0.0.3", **values):
    row = dict(
        source_ip=source,
        destination_ip=destination,
        source_port=5000,
        destination_port=80,
        source_bytes=10,
        destination_bytes=20,
        network_bytes=30,
        source_packets=1,
        destination_packets=2,
        ip_protocol=6,
        protocol="tls",
        event_provider="arkime",
        first_packet=1000,
        last_packet=1500,
    )
    return {**row, **values}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in SESSION_SCHEMA) for r in rows], SESSION_SCHEMA)


def random_sessions(seed, n):
    """A hub takes part in a third of all sessions; nulls, ties, self-sessions and odd addresses occur."""
    rng = random.Random(seed)
    hosts = [f"10.0.{i % 3}.{i}" for i in range(2, 30)] + ["fd00::7", "8.8.8.8", "192.0.2.9", "172.20.1.1"]
    rows = []
    for _ in range(n):
        a, b = rng.choice(hosts), rng.choice(hosts)
        if rng.random() < 0.34:
            a, b = rng.choice([(HUB, b), (a, HUB)])
        start = rng.randrange(10**12)
        rows.append(
            session(
                a,
                b,
                source_port=rng.choice([None, 22, 1023, 1024, 49150, 49151, 65535, rng.randrange(65536)]),
                destination_port=rng.choice([None, 80, 443, 443, 8080, rng.randrange(65536)]),
                source_bytes=rng.choice([None, 0, rng.randrange(5000)]),
                destination_bytes=rng.choice([0, 7, rng.randrange(10**9)]),
                network_bytes=rng.randrange(10**6),
                source_packets=rng.randrange(40),
                destination_packets=rng.randrange(40),
                ip_protocol=rng.choice([1, 6, 6, 17, 17]),
                first_packet=start,
                last_packet=start + rng.randrange(10**5),
            )
        )
    return rows


def internal(rows):
    public = {ip for r in rows for ip in (r["source_ip"], r["destination_ip"]) if ipaddress.ip_address(ip).is_global}
    return [
        r for r in rows if ":" not in r["source_ip"] and r["source_ip"] not in public and r["destination_ip"] not in public
    ]


def check(got, want, names):
    assert set(got) == set(want)
    for key, features in want.items():
        for name in names:
            value, expected = got[key][name], features[name]
            assert value is not None, (key, name)
            assert math.isclose(value, expected, rel_tol=1e-9, abs_tol=1e-9), (key, name, value, expected)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


@pytest.mark.parametrize("user_band", ["as_written", "intended"])
def test_all_features_against_plain_loops(spark, user_band):
    rows = random_sessions(1, 1500)
    got = by_key(X.host_features(frame(spark, rows), user_band=user_band), "ip")
    check(got, brute.host_features(internal(rows), user_band), FEATURES)


def test_small_hosts_ties_and_missing_ports(spark):
    rows = [
        session("10.0.0.2", "10.0.0.3", source_port=None, destination_port=None),
        session("10.0.0.4", "10.0.0.4", source_port=7, destination_port=9),
        session("10.0.0.5", "10.0.0.3", source_port=9),
        session("10.0.0.5", "10.0.0.3", source_port=8),
        session("10.0.0.5", "10.0.0.3", source_port=8, ip_protocol=17),
        session("10.0.0.5", "10.0.0.3", source_port=9, ip_protocol=17),
        session("10.0.0.6", "fd00::1", source_bytes=None),
        session("fd00::1", "10.0.0.7"),
        session(None, "10.0.0.7"),
    ]
    got = by_key(X.host_features(frame(spark, rows)), "ip")
    check(got, brute.host_features([r for r in rows if r["source_ip"] and ":" not in r["source_ip"]]), FEATURES)
    assert got["10.0.0.5"]["source_top5_1"] == 8  # lowest port among equals
    assert got["10.0.0.5"]["ipProtocol_mode"] == 6
    assert "10.0.0.7" not in got  # its only partners are dropped


def test_keys_give_the_same_features_per_group(spark):
    rows = random_sessions(2, 800)
    df = frame(spark, rows).withColumn("slice", F.concat(F.lit("s"), (F.col("network_bytes") % 3).cast("string")))
    got = by_key(X.host_features(df, ["slice"]), "slice", "ip")
    want = {}
    for k in range(3):
        part = brute.host_features([r for r in internal(rows) if r["network_bytes"] % 3 == k])
        want |= {(f"s{k}", ip): f for ip, f in part.items()}
    check(got, want, FEATURES)


def test_single_sets_agree_with_the_assembled_table(spark):
    df = frame(spark, random_sessions(3, 600))
    whole = by_key(X.host_features(df), "ip")
    series = P.port_series(P.gathered(P.value_counts(S.internal_sessions(df))))
    for part in (
        X.li_features(df),
        X.pro_node_features(df),
        X.lyu_features(df),
        P.port_distribution(series),
        P.quartile_shares(series),
        P.count_spread(series),
        P.top_ports(series),
    ):
        names = [c for c in part.columns if c in FEATURES]
        assert names
        check(by_key(part, "ip"), {ip: r.asDict() for ip, r in whole.items()}, names)


def test_shares_descend_and_lists_are_sorted(spark):
    df = S.internal_sessions(frame(spark, random_sessions(4, 500)))
    series = P.port_series(P.value_counts(df))
    for r in P.quartile_shares(series).collect():
        for s in ("source", "destination", "source_inc", "destination_inc"):
            shares = [r[f"{s}_featuresfracq{q}"] for q in range(4)]
            assert shares == sorted(shares, reverse=True)
    for r in P.port_value_counts(df).collect():
        entries = [(-e.cnt, -1 if e.port is None else e.port) for e in r.port_counts]
        assert entries == sorted(entries)


def test_scaling_options(spark):
    df = frame(spark, random_sessions(5, 400))
    plain, scaled, minmax = (by_key(X.li_features(df, scale=s), "ip") for s in (None, "sessions", "minmax"))
    counts = {r["ip"]: r["n"] for r in S.mirror_sessions(S.internal_sessions(df)).groupBy("ip").agg(F.count("source_bytes").alias("n")).collect()}
    for c in X.SESSION_SCALED:
        assert all(math.isclose(scaled[ip][c], plain[ip][c] / n if n else 0) for ip, n in counts.items())
    for c in X.MINMAX_SCALED:
        assert {min(r[c] for r in minmax.values()), max(r[c] for r in minmax.values())} == {0.0, 1.0}
    with pytest.raises(ValueError):
        X.li_features(df, scale="other")


def test_feature_groups_are_nested():
    sizes = {name: len(columns) for name, columns in FEATURE_GROUPS.items()}
    assert sizes == {"statistics": 16, "protocol": 21, "coarse": 36, "all": 94}
    assert len(set(FEATURES)) == 94 and len(COARSE_PORT_FEATURES) == 15


def test_mirror_and_host_sessions(spark):
    df = frame(spark, random_sessions(6, 200))
    assert S.mirror_sessions(df).count() == 2 * df.count()
    self_session = frame(spark, [session("10.0.0.2", "10.0.0.2"), session("10.0.0.3", "10.0.0.2")])
    assert sorted(r.role for r in S.host_sessions(self_session, "10.0.0.2").collect()) == ["destination", "destination", "source"]


def test_cleaning_drops_nulls_and_address_list_matches_the_test(spark):
    rows = [session(), session(protocol=None), session(event_provider=None), session(protocol="lldp,x"), session(event_provider="zeek")]
    assert S.clean_sessions(frame(spark, rows)).count() == 1
    df = frame(spark, random_sessions(7, 300))
    listed = spark.createDataFrame([("8.8.8.8",), (None,)], "ip string")
    both = [sorted(map(repr, S.internal_sessions(df, x).collect())) for x in (None, listed)]
    assert both[0] == both[1]
