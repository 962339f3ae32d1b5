"""Clustering, hard negatives and url rules against plain versions."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostloom.llm import centroids, negatives, url_rules
from hostloom.llm.queries import URL_RULES
from hostloom.session import stored

VECTORS = "vec_id bigint, embedding array<float>, label int, row long, vector string, number int, distance double"


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, count, rounds, dimension):
    kept = [(d, floors(v)) for d, v in rows if usable(v) and len(v) == dimension]
    code = {d: hashlib.sha256(f"2:{d}".encode()).hexdigest() for d, _ in kept}
    start = sorted(kept, key=lambda r: (r[0] is None, code[r[0]], r[1]))
    middles = [v for _, v in start[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        for c, vs in held.items():
            middles[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(d, *nearest(v)) for d, v in kept]
    inertia = defaultdict(int)
    for _, d2, c in found:
        inertia[c] += d2
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    return [(d, c, d2, inertia[c], sum(inertia.values()), sha[c]) for d, d2, c in found]


def plain_negatives(rows, positives=5, wanted=3, low=50, high=95, every=50):
    kept = [(d, floors(v), l) for d, v, l in rows if l is not None and usable(v)]
    last = lambda d: (d is None, d or 0)
    out = []
    for k, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), d, l, j) for j, (d, w, l) in enumerate(kept) if j != k]
        scores.sort(key=lambda s: (-s[0], last(s[1]), s[3]))
        for p, positive, _, _ in [s for s in scores if s[2] == label][:positives]:
            fitting = [s for s in scores if s[2] != label and low * p <= 100 * s[0] <= high * p][:wanted]
            out += [(a, positive, n + 1, s[1], p, s[0]) for n, s in enumerate(fitting)]
    return out


def tuples(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
NEGATIVE = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.fixture(scope="module")
def vectors(spark):
    """Groups around a few centres, copies, ties, rows to leave out and columns with names used inside."""
    random = np.random.default_rng(5)
    middles = random.normal(size=(6, 8))
    rows = [(d, [float(x) for x in middles[d % 6] + 0.4 * random.normal(size=8)], d % 3) for d in range(240)]
    rows += [(d, rows[0][1], 1) for d in (300, 301, 302, 350, 400)]  # copies
    rows += [(100, rows[7][1], 2), (100, rows[7][1], 2), (None, rows[9][1], 0), (-50, rows[3][1], 0)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0] * 7 + [None], 1), (503, [1.0] * 7 + [math.nan], 1)]
    rows += [(504, [1.0] * 7 + [math.inf], 1), (550, rows[2][1], None), (505, [0.0] * 8, 0), (506, [0.5] * 5, 2)]
    rows += [(507, [-1.0] * 9, 2)]
    table = spark.createDataFrame([(d, v, l, 7, "x", 1, 0.5) for d, v, l in rows], VECTORS).repartition(4)
    return rows, table


def test_clusters_equal_a_plain_version(vectors):
    rows, table = vectors
    got = centroids.clustered(table, count=12, rounds=3, pivots=4, dimension=8)
    want = plain_clusters([(d, v) for d, v, _ in rows], 12, 3, 8)
    assert tuples(got, *CLUSTER) == sorted(want, key=repr)


def test_clusters_with_equal_vectors_and_few_rows(spark):
    rows = [(d, [0.25, -1.0, 3.5], 1) for d in range(5)]
    table = spark.createDataFrame([(d, v, l, 7, "x", 1, 0.5) for d, v, l in rows], VECTORS)
    got = centroids.clustered(table, dimension=3)
    assert tuples(got, *CLUSTER) == plain_clusters([(d, v) for d, v, _ in rows], 40, 5, 3)
    assert centroids.clustered(table, dimension=64).collect() == []
    assert centroids.clustered(table.filter("false"), dimension=3).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.integers(1, 6), st.sampled_from([1, 50, 10**5, 2**26]))
def test_bounds_lose_no_centroid(seed, dimension, pivots, size):
    random = np.random.default_rng(seed)
    middles = random.integers(-size, size, (9, dimension), endpoint=True)
    points = np.concatenate([random.integers(-size, size, (50, dimension), endpoint=True), middles])
    fixed = centroids.spread(middles, pivots)
    search = centroids.Nearest(middles, fixed)
    exact = centroids.squares(points, middles)
    assert (search.bounds(centroids.squares(points, fixed)) <= exact).all()
    number, distance, _ = search(points, centroids.squares(points, fixed))
    assert (number == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_bounds_spare_comparisons():
    random = np.random.default_rng(1)
    middles = random.integers(-10000, 10000, (40, 4))
    points = np.repeat(middles, 50, 0) + random.integers(-300, 300, (2000, 4))
    fixed = centroids.spread(middles, 6)
    number, _, compared = centroids.Nearest(middles, fixed)(points, centroids.squares(points, fixed))
    assert compared < 0.1 * len(points) * len(middles)
    assert len(set(number)) == 40


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 70), st.integers(1, 9), st.sampled_from([0, 1, 9, 300, 2**20, 2**27]))
def test_packed_products_are_exact(seed, count, dimension, size):
    random = np.random.default_rng(seed)
    candidates = random.integers(-size, size, (count, dimension), endpoint=True)
    anchors = random.integers(-size, size, (5, dimension), endpoint=True)
    packed = negatives.Packed(candidates, int((anchors * anchors).sum(1).max()))
    assert (packed.scores(anchors) == anchors @ candidates.T).all()
    assert packed.fields >= 2 or size > 300


@pytest.mark.parametrize("cell", [None, (16, 4), (1, 1000)])
def test_negatives_equal_a_plain_version(vectors, cell):
    rows, table = vectors
    got = negatives.hard_negatives(table, cell=cell)
    want = plain_negatives(rows)
    assert len(want) > 50
    assert tuples(got, *NEGATIVE) == sorted(want, key=repr)


def test_negatives_of_empty_tables_and_single_labels(vectors):
    _, table = vectors
    assert negatives.hard_negatives(table.filter("false")).collect() == []
    assert negatives.hard_negatives(table.filter("label = 1")).collect() == []
    assert negatives.hard_negatives(table.filter("vec_id % 50 <> 0")).collect() == []


def test_relabelled_rows(spark):
    rows = [(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 9), (None, None, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert [r["label"] for r in negatives.relabelled(table).collect()] == [0, 4, 9, None]


URLS = [
    (1, "http://A.Example.ORG/en/1x?q#f"),
    (2, None),
    (3, "no scheme/org/"),
    (4, "http://x.org"),
    (5, "x://com/fr/"),
    (5, "x://com/fr/"),
    (None, "a://b.com/de/é#x"),
    (7, "a://h#/org/?"),
    (8, "a://example.org?x/y#z"),
    (9, ""),
    (10, "http://example.org/es/://org/"),
    (11, "http://notexample.org/es/1"),
    (12, "http://example.org./es/1"),
    (13, "http://ÀB.Com:80/de/"),
    (14, "http://u@com/de/x" + "/y" * 60000),
    (15, "http://" + "a." * 3000 + "com/fr/"),
    (16, "://org/"),
    (17, "http:///es/"),
    (18, "http://😀.com/fr/\n?x"),
]


def plain_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host = rest.split("/")[0]
    path = rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h) + len(p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def pages(spark, rows):
    return spark.createDataFrame(
        [(d, u, "<html>", "h", "p", 3) for d, u in rows],
        "page_id bigint, url string, html string, host string, path string, key int",
    ).repartition(3)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_verdicts_equal_a_plain_version(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = url_rules.judged(pages(spark, URLS), url_rules.rules(spark, URL_RULES))
        got = tuples(got, "page_id", "host", "path", "rule", "verdict")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(((d, *plain_verdict(u, URL_RULES)) for d, u in URLS), key=repr)


def test_rule_tables(spark):
    given_rules = [
        ("a.b", "/x", "block"),
        ("A.B", "/x", "allow"),  # the same rule: block counts
        ("b", "", "block"),
        ("b", "/x", "allow"),
        ("b", "/x/y", "allow"),
        (None, "/", "block"),
        ("", "/", "block"),
        ("c", None, "block"),
        ("c", "/", None),
        ("c", "/", "other"),
    ]
    table = spark.createDataFrame(given_rules, "host string, path string, verdict string")
    rows = [(1, "s://a.b/xx"), (2, "s://z.b/xx"), (3, "s://b"), (4, "s://a.b/x/y"), (5, "s://c/")]
    got = url_rules.judged(pages(spark, rows), stored(table, "rules"), default="unknown").select("page_id", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == [
        (1, "a.b/x", "block"),
        (2, "b/x", "allow"),
        (3, "b", "block"),
        (4, "a.b/x", "block"),
        (5, None, "unknown"),
    ]


def test_no_rules_and_no_pages(spark):
    got = url_rules.judged(pages(spark, URLS), url_rules.rules(spark, []), default="block").collect()
    assert len(got) == len(URLS) and {(r["rule"], r["verdict"]) for r in got} == {(None, "block")}
    assert url_rules.judged(pages(spark, []), url_rules.rules(spark, URL_RULES)).collect() == []


def test_url_plan_is_native(spark):
    df = url_rules.judged(pages(spark, URLS), url_rules.rules(spark, URL_RULES))
    df.collect()
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
