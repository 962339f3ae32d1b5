"""Boosted trees against a plain version that looks at every split one by one."""

import math
import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyarrow import fs
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from hostloom.operators import boosting as B
from hostloom.operators import dataset as D
from hostloom.operators import models as M
from hostloom.schema import FEATURES


def plain_tree(bins, g, h, depth):
    """{path: (feature, bin, gain) or leaf value}, splits tried one by one."""
    out = {}

    def node(rows, path, left):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (B.LEAST_GAIN, None, None)
        for f in range(bins.shape[1]):
            for at in range(B.BINS - 1):
                a = rows[bins[rows, f] <= at]
                b = rows[bins[rows, f] > at]
                if h[a].sum() < B.LEAST_WEIGHT or h[b].sum() < B.LEAST_WEIGHT:
                    continue
                gain = sum(g[x].sum() ** 2 / (h[x].sum() + B.L2) for x in (a, b)) - total_g**2 / (total_h + B.L2)
                if gain > best[0] + 1e-9:
                    best = (gain, f, at)
        if best[1] is None or left == 0:
            out[path] = ("leaf", -B.LEARNING_RATE * total_g / (total_h + B.L2), total_h)
            return
        out[path] = (best[1], best[2], best[0], total_h)
        low = bins[rows, best[1]] <= best[2]
        node(rows[low], path + "l", left - 1)
        node(rows[~low], path + "r", left - 1)

    node(np.arange(len(g)), "", math.inf if depth is None else depth)
    return out


@pytest.mark.parametrize("depth", [1, 3, None])
@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_a_plain_version(seed, depth):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, B.BINS, (90, 5)).astype(np.uint8)
    bins[:, 4] = 7  # no split there
    g, h = rng.normal(size=(90, 3)), rng.uniform(0.1, 1, (90, 3))
    (kind, name, feature, at, gain, cover, left, right, value), values = B.grow(bins, g, h, depth)
    for k in range(3):
        want = plain_tree(bins, g[:, k], h[:, k], depth)
        mine = {n: i for i, n in zip(np.flatnonzero(kind == k), name[kind == k])}
        assert sorted(mine) == list(range(len(want)))
        todo, seen = [(0, "", np.arange(90))], 0
        while todo:
            number, path, rows = todo.pop()
            i, seen = mine[number], seen + 1
            assert cover[i] == pytest.approx(want[path][-1])
            if want[path][0] == "leaf":
                assert feature[i] == -1 and value[i] == pytest.approx(want[path][1])
                assert values[rows, k] == pytest.approx(want[path][1])
                continue
            assert (feature[i], at[i]) == want[path][:2] and gain[i] == pytest.approx(want[path][2])
            low = bins[rows, feature[i]] <= at[i]
            todo += [(left[i], path + "l", rows[low]), (right[i], path + "r", rows[~low])]
        assert seen == len(want)


def test_histograms_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, B.BINS, (200, 6)).astype(np.uint8)
    g, h = rng.normal(size=(200, 4)), rng.uniform(0.5, 1, (200, 4))
    nodes, values = B.grow(bins, g, h, 4)
    monkeypatch.setattr(B, "_ENTRIES", 700)
    again, same = B.grow(bins, g, h, 4)
    assert all(np.allclose(x, y) for x, y in zip(nodes, again)) and np.allclose(values, same)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    table = []
    for i in range(240):
        x = [round(rng.gauss(0, 1), 2) for _ in range(94)]
        y = (x[0] > 0) + 2 * (x[1] > 0.4)
        table.append((f"10.0.{i // 100}.{i % 100}", int(y), *x))
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    df = spark.createDataFrame(table, f"ip string, y_label bigint, {columns}").repartition(3)
    return M.weighted(M.assembled(D.stratified_folds(df, "y_label", 3), "y_label")).cache()


def plain_margins(nodes, x, classes):
    out = np.zeros((len(x), len(classes)))
    table = {(r["round"], r["class"], r["node"]): r for r in nodes}
    for number, kind in {(r["round"], r["class"]) for r in nodes}:
        for i, row in enumerate(x):
            n = table[number, kind, 0]
            while n["feature"] >= 0:
                n = table[number, kind, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"]]
            out[i, classes.index(kind)] += n["value"]
    return out


def test_models_as_tables(spark, rows, tmp_path):
    every = F.array(F.lit("a"), F.lit("b"))
    nodes = B.fit(rows, every, 4, {"a": 2, "b": None})
    names = ["a", "b"]
    assert {r["model"] for r in nodes.select("model").distinct().collect()} == set(names)
    scored = {(r["model"], r["ip"]): r["y_pred"] for r in B.predict(rows, nodes, every, ["ip"]).collect()}
    assert len(scored) == 480
    data = rows.select("ip", "features").collect()
    x = np.array([r["features"].toArray() for r in data])
    for name in names:
        own = nodes.filter(F.col("model") == name).collect()
        classes = sorted({r["class"] for r in own})
        best = plain_margins(own, x, classes).argmax(axis=1)
        assert [scored[name, r["ip"]] for r in data] == [classes[k] for k in best]
    B.write_models(nodes, f"{tmp_path}/models")
    again = B.read_models(spark, f"{tmp_path}/models")
    assert {(r["model"], r["ip"]): r["y_pred"] for r in B.predict(rows, again, every, ["ip"]).collect()} == scored
    # Importances by SQL over the node table.
    nodes.createOrReplaceTempView("nodes")
    want = spark.sql(
        "SELECT model, feature, gain / sum(gain) OVER (PARTITION BY model) AS share FROM "
        "(SELECT model, feature, avg(gain) AS gain FROM nodes WHERE feature >= 0 GROUP BY model, feature)"
    ).collect()
    got = {(r["model"], r["feature"]): r["importance"] for r in B.importances(again, FEATURES).collect()}
    assert len(got) == 2 * len(FEATURES)
    got = {k: v for k, v in got.items() if v}
    assert got == pytest.approx({(r["model"], FEATURES[r["feature"]]): r["share"] for r in want})


def test_deeper_models_agree_where_depth_does_not_bind(rows):
    """The first round of an unlimited tree holds the splits of every shallower one."""
    every = F.array(F.lit("2"), F.lit("no"))
    nodes = B.fit(rows, every, 1, {"2": 2, "no": None}).collect()
    splits = {m: {(r["class"], r["feature"], r["threshold"]) for r in nodes if r["model"] == m and r["feature"] >= 0} for m in ("2", "no")}
    assert splits["2"] and splits["2"] <= splits["no"]


def test_fits_repeat_exactly_in_any_order(rows):
    one = F.array(F.lit("m"))
    first = B.fit(rows, one, 3, {"m": 4}).collect()
    second = B.fit(rows.repartition(7, "ip"), one, 3, {"m": 4}).collect()
    assert sorted(first) == sorted(second)


def test_bounded_rows_and_blocks(rows, monkeypatch):
    one = F.array(F.lit("m"))
    whole = {r["ip"]: r["y_pred"] for r in B.predict(rows, B.fit(rows, one, 3, {"m": 3}), one, ["ip"]).collect()}
    monkeypatch.setattr(B, "SCORED_ROWS", 50)
    nodes = B.fit(rows, one, 3, {"m": 3})
    assert {r["ip"]: r["y_pred"] for r in B.predict(rows, nodes, one, ["ip"]).collect()} == whole
    monkeypatch.setattr(B, "MAX_ROWS", 100)
    cover = B.fit(rows, one, 1, {"m": 1}).filter("node = 0").agg(F.sum("cover")).first()[0]
    assert 0 < cover < nodes.filter("node = 0 and round = 0").agg(F.sum("cover")).first()[0]


def test_one_class_and_no_rows(rows):
    one = F.array(F.lit("m"))
    single = rows.filter("y = 1")
    got = B.predict(single, B.fit(single, one, 2, {"m": 3}), one, ["ip"])
    assert {r["y_pred"] for r in got.collect()} == {1}
    none = rows.filter("false")
    assert B.fit(none, one, 2, {"m": 3}).collect() == []
    assert {r["y_pred"] for r in B.predict(single, B.fit(none, one, 2, {"m": 3}), one, ["ip"]).collect()} == {None}


def test_boosted_grid_lists_every_depth(rows):
    settings = M.Trees("boosted_trees", iterations=3)
    grid = M.depth_grid(rows, [settings], depths=(1, 32, None), folds=(0, 1)).collect()
    assert {r["max_depth"] for r in grid} == {1, 32, None}
    by = {r["max_depth"]: r for r in grid}
    assert by[None].mean_train_score == pytest.approx(by[32].mean_train_score)
    assert by[None].mean_train_score > by[1].mean_train_score


def test_boosted_static_and_slice_models(rows):
    slices = rows.withColumns({"slice": F.lit("d1_1"), "slice_no": F.lit(1)}).drop("weight")
    settings = M.Trees("boosted_trees", depth=2, iterations=3)
    for model in (None, True):
        both = M.static_vs_slice_folds(rows.drop("weight"), slices, settings, range(3), static_model=model)
        assert both.columns == ["ip", "slice", "slice_no", "y_true", "pred_static", "pred_slice", "fold"]
        assert both.count() == 240 and both.filter("pred_static = y_true").count() > 150
    top = M.fold_importances(rows, settings, (0, 1), 3).collect()
    assert len(top) == 6 and {FEATURES.index(r["feature"]) for r in top} >= {0, 1}


def test_the_larger_child_is_not_counted(monkeypatch):
    """What is left of the parent gives the same trees, whether columns are counted one by one, jointly or all at once."""
    rng = np.random.default_rng(7)
    bins = np.stack([rng.integers(0, n, 3000) for n in (2, 5, 9, 33, B.BINS, 1, B.BINS)], axis=1).astype(np.uint8)
    g, h = rng.normal(size=(3000, 3)) + (bins[:, 3:4] > 20), rng.uniform(0.1, 1, (3000, 3))
    counted, whole = [], B.Columns.histograms

    def counting(self, row, slot, weights, slots):
        counted.append(0 if row is None else len(row))
        return whole(self, row, slot, weights, slots)

    monkeypatch.setattr(B.Columns, "histograms", counting)
    found = {}
    for few, many in ((1, 1), (1, 1 << 40), (1 << 40, 1 << 40)):
        monkeypatch.setattr(B, "_FEW", few)
        monkeypatch.setattr(B, "_MANY", many)
        counted.clear()
        found[few, many] = B.grow(bins, g, h, 5), sum(counted)
    (nodes, values), most = found.pop((1 << 40, 1 << 40))
    assert 1 in B.Columns(bins).features and 5 not in B.Columns(bins).features
    for (other, same), entries in found.values():
        assert all(np.allclose(a, b) for a, b in zip(nodes, other)) and np.allclose(values, same)
        assert entries <= most / 2


def _trees(nodes):
    kept = ("model", "round", "class", "node", "feature", "left", "right")
    rows = sorted(tuple(r) for r in nodes.select(*kept, "threshold", "gain", "cover", "value").collect())
    return [r[:7] for r in rows], np.array([r[7:] for r in rows])


@pytest.mark.parametrize("parts", [8, 3])
def test_rows_of_a_model_in_several_tasks(spark, rows, monkeypatch, parts):
    """Models of many rows are fitted by all tasks together on every row: the trees of one task."""
    every = F.array_compact(F.array(*(F.when(F.col("fold") != f, F.lit(str(f))) for f in (0, 1)), F.lit("all")))
    depths = {"0": 3, "1": None, "all": 2}
    one, numbers = _trees(B.fit(rows, every, 4, depths))
    monkeypatch.setattr(B, "GROUP_ROWS", 200)  # "all" has 240 rows, the folds fewer
    some, of_some = _trees(B.fit(rows, every, 4, depths))
    monkeypatch.setattr(B, "GROUP_ROWS", 0)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", parts)
    apart, of_apart = _trees(B.fit(rows, every, 4, depths))
    assert one == some == apart
    assert numbers == pytest.approx(of_some) and numbers == pytest.approx(of_apart, abs=1e-9)


class _Peer(B.Peers):
    """A thread in the place of a task."""

    def __init__(self, rank, count, folder):
        self.rank, self.count, self._folder, self._files, self._turn = rank, count, str(folder), fs.LocalFileSystem(), 0


def test_histograms_of_parts_of_the_rows(tmp_path, monkeypatch):
    """Larger children are what is left of their parents, several exchanges a level, and one part has no rows."""
    rng = np.random.default_rng(11)
    bins = np.stack([rng.integers(0, n, 900) for n in (2, 5, 33, B.BINS, 1, B.BINS)], axis=1).astype(np.uint8)
    y, weight = (bins[:, 3] > 20) + 2.0 * (bins[:, 1] > rng.integers(0, 5, 900)), rng.uniform(0.5, 2, 900)
    edges = [np.arange(n - 1.0) for n in (2, 5, 33, B.BINS, 1, B.BINS)]
    monkeypatch.setattr(B, "_FEW", 10)
    monkeypatch.setattr(B, "_EXCHANGED", 6 * B.BINS * 3)
    monkeypatch.setattr(B, "_CACHED", 6 * B.BINS * 2)
    part = rng.integers(0, 4, 900)

    def task(rank):
        own = part == rank
        return B.boosted(bins[own], y[own], weight[own], edges, 3, 6, _Peer(rank, 5, tmp_path))

    with ThreadPool(5) as pool:
        found = pool.map_async(task, range(5)).get(60)
    want = B.boosted(bins, y, weight, edges, 3, 6)
    assert max(want["node"].to_pylist()) > 40
    for nodes in found:
        for name in want.column_names:
            assert nodes[name].to_pylist() == pytest.approx(want[name].to_pylist(), abs=1e-9), name
    assert len(list(tmp_path.iterdir())) == 5  # of the last turn only


def test_no_row_is_left_out_of_a_large_model(spark):
    """More rows than one task takes: the weights at the first node are those of all rows."""
    n = 200_100
    value = (F.hash("id") % 8).cast("double")
    frame = spark.range(n, numPartitions=8).select(F.col("id").cast("string").alias("ip"), F.array(value, value * value).alias("x"))
    frame = frame.select("ip", array_to_vector("x").alias("features"), (F.col("x")[0] > 1).cast("double").alias("y"), F.lit(1.0).alias("weight"))
    nodes = B.fit(frame, F.array(F.lit("m")), 1, {"m": 1})
    roots = nodes.filter("node = 0").collect()
    assert len(roots) == 2 and all(r["cover"] == pytest.approx(n / 2) for r in roots)
