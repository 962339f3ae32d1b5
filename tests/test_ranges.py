"""Range tables: equal to the built-in test with the standard table, longest prefix with any other."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F
from test_addresses import _texts

from hostloom.functions import ranges as G
from hostloom.sources import readers, writers

NO_ADDRESS = ["", "host", "8.8.8", "8.8.8.256", "08.8.8.8", "1:2:3", "g::1", "12345::1", ":::", "8.8.8.8 ", "::1.2.3.256"]


def judged(spark, texts, ranges):
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    return {r["ip"]: r["public"] for r in df.select("ip", G.is_public_by(F.col("ip"), ranges).alias("public")).collect()}


def test_the_standard_table_equals_the_built_in_test(spark):
    texts = sorted(set(_texts()))
    got = judged(spark, texts + NO_ADDRESS + [None], G.compiled(G.standard_ranges()))
    wrong = [t for t in texts if got[t] != ipaddress.ip_address(t).is_global]
    assert not wrong, (len(wrong), wrong[:10])
    assert not any(got[t] for t in NO_ADDRESS + [None])


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_prefix_of_random_tables(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(60):
        bits, base = rng.choice([(32, 0x0A000000), (128, 0x20010DB8 << 96)])
        # Short distances between lengths and few values make many nested and touching ranges.
        length = rng.choice([0, 1, 8, 9, bits - 8, bits - 7, bits - 6, bits - 4, bits - 1, bits])
        number = (base + rng.getrandbits(8)) >> (bits - length) << (bits - length)
        form = ipaddress.IPv4Address if bits == 32 else ipaddress.IPv6Address
        rows[f"{form(number)}/{length}"] = rng.random() < 0.5
    nets = [(ipaddress.ip_network(c), f) for c, f in rows.items()]
    addresses = [ipaddress.IPv4Address(0x0A000000 + k) for k in range(-3, 260)]
    addresses += [ipaddress.IPv6Address((0x20010DB8 << 96) + k) for k in range(-3, 260)]
    addresses += [ipaddress.ip_address(t) for t in ("0.0.0.0", "255.255.255.255", "::", "ffff:" * 7 + "ffff")]

    def expected(address):
        around = [(n.prefixlen, f) for n, f in nets if n.version == address.version and address in n]
        return max(around)[1] if around else True

    got = judged(spark, [str(a) for a in addresses], G.compiled(rows.items()))
    assert got == {str(a): expected(a) for a in addresses}


def test_tables_without_ranges_and_with_bad_ones(spark):
    assert judged(spark, ["10.0.0.1", "::1"], G.compiled([])) == {"10.0.0.1": True, "::1": True}
    assert judged(spark, ["10.0.0.1"], G.compiled([], default=False)) == {"10.0.0.1": False}
    for rows in ([("10.0.0.0/8", True), ("10.0.0.0/8", False)], [("10.0.0.1/8", True)], [("host", True)]):
        with pytest.raises(ValueError):
            G.compiled(rows)


def test_versions_on_disk(spark, tmp_path):
    path = str(tmp_path / "ranges")
    with pytest.raises(ValueError):
        readers.read_ranges(spark, path)
    schema = "cidr string, is_global boolean"
    for version in (1, 2, 10):
        writers.write_ranges(spark.createDataFrame([("10.0.0.0/8", version == 2)], schema), path, version)
    with pytest.raises(Exception, match="exists"):
        writers.write_ranges(spark.createDataFrame([("10.0.0.0/8", True)], schema), path, 2)
    assert readers.range_versions(spark, path) == [1, 2, 10]
    assert readers.read_ranges(spark, path, 2) == G.compiled([("10.0.0.0/8", True)])
    assert readers.read_ranges(spark, path) == G.compiled([("10.0.0.0/8", False)])
    with pytest.raises(ValueError):
        readers.read_ranges(spark, path, 3)


def test_the_lookup_is_an_expression(spark):
    df = spark.range(3).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string")).alias("ip"))
    plan = df.filter(G.is_public_by(F.col("ip"), G.compiled(G.standard_ranges())))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan
