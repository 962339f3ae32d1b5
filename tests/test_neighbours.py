"""Neighbour graph and layout against plain versions."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from hostloom.operators import neighbours as N

SCHEMA = "id bigint, v array<double>"


def frame(spark, vectors):
    plain = [None if v is None else [None if x is None else float(x) for x in v] for v in vectors]
    return spark.createDataFrame(list(enumerate(plain)), SCHEMA)


def exact(vectors, k):
    """Nearest others by plain sorting: {row: [neighbour, ...]}."""
    units = np.asarray(vectors, dtype=float)
    length = np.linalg.norm(units, axis=1, keepdims=True)
    units = units / np.where(length > 0, length, 1)
    distance = np.round(np.maximum(1 - units @ units.T, 0), 6)
    order = {i: sorted((d, j) for j, d in enumerate(row) if j != i)[:k] for i, row in enumerate(distance)}
    return {i: [j for _, j in near] for i, near in order.items()}, distance


def by_row(graph):
    found = defaultdict(list)
    for r in sorted(graph.collect(), key=lambda r: (r["id"], r["rank"])):
        found[r["id"]].append(r["neighbour"])
    return found


def test_one_leaf_is_exact_with_ties_copies_and_zero_vectors(spark):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-2, 3, size=(60, 3)).tolist() + [[0, 0, 0], [1, 1, 1], [2, 2, 2], [1, 1, 1]]
    want, distance = exact(vectors, 5)
    graph = N.neighbour_graph(frame(spark, vectors), "id", "v", 5)
    assert by_row(graph) == want
    for r in graph.collect():
        assert r["distance"] == pytest.approx(distance[r["id"], r["neighbour"]], abs=2e-6)


def test_rows_without_a_vector_and_clashing_columns(spark):
    vectors = [[1, 0], None, [1, None], [math.inf, 1], [math.nan, 1], [0, 1], [1, 1]]
    rows = frame(spark, vectors).selectExpr("id", "v", "'x' AS unit", "1 AS key", "2 AS tree", "3 AS node", "4 AS distance")
    assert by_row(N.neighbour_graph(rows, "id", "v", 2)) == {0: [6, 5], 5: [6, 0], 6: [0, 5]}
    assert N.neighbour_graph(rows.filter("id = 0"), "id", "v").collect() == []
    empty = N.neighbour_graph(rows.filter("false"), "id", "v")
    assert empty.columns == ["id", "rank", "neighbour", "distance"] and empty.collect() == []


def blobs(count, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(12, 20))[rng.integers(0, 12, count)] + rng.normal(size=(count, 20)) * 0.5


def test_recall_and_equal_output_for_equal_seed(spark):
    vectors = blobs(1500)
    want, _ = exact(vectors, 10)
    rows = frame(spark, vectors)
    found = by_row(N.neighbour_graph(rows, "id", "v", 10))
    assert all(len(near) == 10 and i not in near for i, near in found.items())
    recall = np.mean([len(set(found[i]) & set(want[i])) / 10 for i in want])
    assert recall >= 0.9
    assert by_row(N.neighbour_graph(rows.repartition(5), "id", "v", 10)) == found


def test_copies_do_not_fill_a_leaf(spark):
    vectors = [[1.0, 2.0, 3.0]] * 700 + blobs(700)[:, :3].tolist()
    points = N.unit_vectors(frame(spark, vectors), "id", "v")
    forest = N.Forest(trees=3, leaf=50)
    sizes = Counter((r["tree"], r["node"]) for r in N.leaves(points, forest).collect())
    assert sum(sizes.values()) == 3 * len(vectors) and max(sizes.values()) <= 60


def test_rows_that_share_a_key_count_as_one(spark):
    rows = frame(spark, blobs(300))
    twice = rows.unionAll(rows).unionAll(rows.filter("id % 3 = 0"))
    found = by_row(N.neighbour_graph(twice, "id", "v", 5))
    assert found == by_row(N.neighbour_graph(rows, "id", "v", 5)) and all(i not in near for i, near in found.items())
    leaf_rows = Counter((r["key"], r["tree"]) for r in N.leaves(N.unit_vectors(twice, "id", "v"), N.Forest(trees=2)).collect())
    assert len(leaf_rows) == 600 and set(leaf_rows.values()) == {1}


def test_small_nodes_are_halved_in_one_task_to_the_same_leaves(spark, monkeypatch):
    points = N.unit_vectors(frame(spark, blobs(1500)), "id", "v").cache()
    written = []
    monkeypatch.setattr(N, "stored", lambda df, name, keep=N.stored: written.append(name) or keep(df, name))

    def found():
        written.clear()
        rows = N.leaves(points, N.Forest(trees=3, leaf=50)).collect()
        return {(r["key"], r["tree"]): r["node"] for r in rows}, len(written)

    in_tasks, tables = found()
    assert tables == 0
    monkeypatch.setattr(N, "_BLOCK_ROWS", 50)
    level_by_level, tables = found()
    assert tables == 6 and level_by_level == in_tasks


def test_weights_against_a_plain_version(spark):
    vectors = blobs(40)
    graph = N.neighbour_graph(frame(spark, vectors), "id", "v", 6)
    links = defaultdict(list)
    for r in graph.collect():
        links[r["id"]].append((r["neighbour"], r["distance"]))
    one_way = {}
    for i, near in links.items():
        nearest = min(d for _, d in near)
        low, high = 0.0, 64.0
        for _ in range(60):
            middle = (low + high) / 2
            wide = sum(math.exp(-(d - nearest) / middle) for _, d in near) > math.log2(len(near))
            low, high = (low, middle) if wide else (middle, high)
        one_way |= {(i, j): math.exp(-(d - nearest) / high) for j, d in near}
    want = {}
    for i, j in one_way:
        a, b = one_way[i, j], one_way.get((j, i), 0.0)
        want[i, j] = want[j, i] = a + b - a * b
    got = {(r["id"], r["neighbour"]): r["weight"] for r in N.neighbour_weights(graph, "id").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_layout_keeps_neighbours_better_than_its_start(spark):
    vectors = blobs(300)
    want, _ = exact(vectors, 10)
    graph = N.neighbour_graph(frame(spark, vectors), "id", "v", 10)
    centred = vectors - vectors.mean(0)
    start = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T

    def kept(places):
        distance = ((places[:, None] - places[None]) ** 2).sum(-1)
        np.fill_diagonal(distance, np.inf)
        near = np.argsort(distance, axis=1)[:, :10]
        return np.mean([len(set(near[i]) & set(want[i])) / 10 for i in want])

    first = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(start)], "id bigint, x double, y double")
    placed = N.neighbour_layout(first, N.neighbour_weights(graph, "id"), "id", N.Layout(epochs=15)).collect()
    places = np.array([(r["x"], r["y"]) for r in sorted(placed, key=lambda r: r["id"])])
    assert len(places) == 300 and np.isfinite(places).all()
    assert kept(places) > kept(start) + 0.1
    none = N.neighbour_layout(first.filter("false"), N.neighbour_weights(graph.filter("false"), "id"), "id", N.Layout(epochs=1))
    assert none.collect() == []


def test_layout_of_rows_that_share_a_key(spark):
    links = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5)]
    weights = spark.createDataFrame(links, "id bigint, neighbour bigint, weight double")
    start = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.5), (2, -1.0, 2.0)], "id bigint, x double, y double")

    def placed(rows):
        found = N.neighbour_layout(rows, weights, "id", N.Layout(epochs=2)).collect()
        assert len(found) == 3
        return [v for r in sorted(found) for v in r]

    assert placed(start.unionAll(start).unionAll(start.filter("id = 1"))) == pytest.approx(placed(start), abs=1e-9)
