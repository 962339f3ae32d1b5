import ipaddress
import random

from pyspark.sql import functions as F

from hostloom.functions import addresses as A


def _edges():
    for cidr in A.V4_PRIVATE + A.V4_EXCEPTIONS + A.V4_SHARED + A.V6_PRIVATE + A.V6_EXCEPTIONS:
        net = ipaddress.ip_network(cidr)
        form = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        first, last = int(net.network_address), int(net.broadcast_address)
        for value in (first - 1, first, first + 1, (first + last) // 2, last - 1, last, last + 1):
            if 0 <= value < 2**net.max_prefixlen:
                yield form(value)


def _texts():
    rng = random.Random(5)
    addresses = list(_edges())
    addresses += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(300)]
    addresses += [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(200)]
    # Many zero groups, so that "::" appears in every position.
    for _ in range(400):
        groups = [rng.choice(["0", "0", "0", f"{rng.getrandbits(16):x}"]) for _ in range(8)]
        addresses.append(ipaddress.IPv6Address(":".join(groups)))
    for a in addresses:
        yield str(a)
        if a.version == 6:
            yield a.exploded
            yield str(a).upper() + "%eth0"
        else:
            number = int(a)
            yield f"::ffff:{a}"
            yield f"::ffff:{number >> 16:x}:{number & 0xFFFF:x}"
            yield f"64:ff9b::{a}"
            yield f"1:2:3:4:5:6:{a}"


def test_public_follows_ipaddress(spark):
    texts = sorted(set(_texts()))
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    rows = df.select(
        "ip", A.is_public(F.col("ip")).alias("public"), A.is_ipv4(F.col("ip")).alias("v4")
    ).collect()
    wrong = [
        (r.ip, r.public, r.v4)
        for r in rows
        if r.public != ipaddress.ip_address(r.ip).is_global or r.v4 != (ipaddress.ip_address(r.ip).version == 4)
    ]
    assert not wrong, (len(wrong), wrong[:10])


def test_text_that_is_no_address(spark):
    texts = ["", "host", "8.8.8", "8.8.8.256", "08.8.8.8", "8.8.8.8.8", "1:2:3", "g::1", "12345::1", ":::", "8.8.8.8 "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ip string")
    rows = df.select(A.is_public(F.col("ip")).alias("public"), A.is_ipv4(F.col("ip")).alias("v4")).collect()
    assert not any(r.public or r.v4 for r in rows)


def test_octets(spark):
    df = spark.createDataFrame([("10.2.30.255",), ("fd00::5",), ("10.x.1",)], "ip string")
    rows = df.select([A.octet(F.col("ip"), i).alias(f"o{i}") for i in range(1, 5)]).collect()
    assert [tuple(r) for r in rows] == [(10, 2, 30, 255), (None,) * 4, (10, None, 1, None)]


def test_internal_beginnings_agree_with_the_pattern_and_come_first(spark):
    ranges = [ipaddress.ip_network(c) for c in A.V4_PRIVATE + A.V4_SHARED]
    texts = [str(net[0]) for net in ranges] + ["10.", "10.x", "100.64.0.1", "10", "172.15.0.1", "172.32.0.1", "192.0.0.9", "1.10.0.1", " 10.0.0.1"]
    texts += ["fd00::5", "FD00::5", "fd::5", "fd00", "fd00::5::6", "2002:808:808::1", "fe80::1%eth0", "::fd00:0", "2001:4860:4860::8888"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ip string")
    ip = F.col("ip")
    plain = F.when(A.is_ipv6(ip), A.ipv6_digits(ip).rlike(A._V6_GLOBAL)).otherwise(ip.rlike(A._V4_GLOBAL))
    assert df.filter(~A.is_public(ip).eqNullSafe(plain)).count() == 0
    plan = df.filter(~A.is_public_v4(ip))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("StartsWith(ip") < plan.index("RLIKE")
