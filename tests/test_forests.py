"""Forests against a plain version that looks at every split one by one, and against MLlib's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostloom.operators import dataset as D
from hostloom.operators import forests as R
from hostloom.operators import models as M
from hostloom.schema import FEATURES


def gini(y, weight):
    share = np.bincount(y, weight) / weight.sum()
    return 1 - (share**2).sum()


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_a_tree_of_all_features_equals_a_plain_version(depth, monkeypatch):
    monkeypatch.setattr(R, "_CELLS", 5 * R.BINS * 3 * 2)  # two nodes at once
    rng = np.random.default_rng(4)
    bins, y, weight = rng.integers(0, R.BINS, (150, 5)).astype(np.uint8), rng.integers(0, 3, 150), rng.uniform(0.2, 2, 150)
    feature, at, left, right, stats = R.grow(bins, y, weight, 3, depth, 5, rng)
    todo, seen = [(0, np.arange(150), 0)], 0
    while todo:
        node, rows, level = todo.pop()
        seen += 1
        assert stats[node] == pytest.approx(np.bincount(y[rows], weight[rows], 3))
        best = (1e-12, -1, 0)
        for f in range(5):
            for cut in range(R.BINS - 1):
                low = rows[bins[rows, f] <= cut]
                high = rows[bins[rows, f] > cut]
                if len(low) and len(high):
                    parts = sum(gini(y[p], weight[p]) * weight[p].sum() for p in (low, high)) / weight[rows].sum()
                    gain = gini(y[rows], weight[rows]) - parts
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, f, cut)
        if level == depth or len(set(y[rows])) == 1 or best[1] < 0:
            assert feature[node] == -1
            continue
        assert (feature[node], at[node]) == best[1:]
        low = bins[rows, feature[node]] <= at[node]
        todo += [(left[node], rows[low], level + 1), (right[node], rows[~low], level + 1)]
    assert seen == len(feature)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    table = []
    for i in range(400):
        x = [round(rng.gauss(0, 1), 2) for _ in range(94)]
        for k in range(0, 40, 2):  # many features show the class, as few are drawn per node
            x[k], x[k + 1] = x[0] + rng.gauss(0, 0.3), x[1] + rng.gauss(0, 0.3)
        table.append((f"10.0.{i // 100}.{i % 100}", int((x[0] > 0) + 2 * (x[1] > 0.4)), *x))
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    df = spark.createDataFrame(table, f"ip string, y_label bigint, {columns}").repartition(3)
    return M.weighted(M.assembled(D.stratified_folds(df, "y_label", 3), "y_label")).cache()


def test_the_grid_scores_as_mllib_does_without_its_fits(rows, monkeypatch):
    settings = M.Trees("random_forest", trees=30)
    got = {r.max_depth: r for r in M.depth_grid(rows, [settings], depths=(1, 4, None), folds=(0, 1)).collect()}
    monkeypatch.setattr(R, "FOREST_ROWS", 0)
    want = {r.max_depth: r for r in M.depth_grid(rows, [settings], depths=(1, 4, None), folds=(0, 1)).collect()}
    assert sorted(got) == sorted(want) == [1, 4, 30]
    for depth in (4, 30):
        assert got[depth].mean_test_score == pytest.approx(want[depth].mean_test_score, abs=0.12)
        assert got[depth].mean_train_score == pytest.approx(want[depth].mean_train_score, abs=0.08)
    monkeypatch.undo()
    monkeypatch.setattr(M.Trees, "estimator", lambda self: pytest.fail("MLlib moves every node's histograms"))
    assert M.depth_grid(rows, [settings], depths=(1,), folds=(0,)).count() == 1


def test_forests_repeat_and_leave_the_fold_out(rows):
    nodes = R.fit(rows, (0, 1), 5, 30, True, 0, ["ip"])
    again = R.fit(rows.repartition(7, "ip"), (0, 1), 5, 30, True, 0, ["ip"])
    assert sorted(map(repr, nodes.collect())) == sorted(map(repr, again.collect()))
    assert {(r.fold, r.tree) for r in nodes.collect()} == {(f, t) for f in (0, 1) for t in range(5)}
    one = R.fit(rows.withColumn("weight", F.lit(1.0)), (0, 1), 1, 30, False, 0, ["ip"]).filter("node = 0")
    for r in one.collect():  # a single tree takes every row once
        assert sum(r.stats) == rows.filter(F.col("fold") != r.fold).count()
