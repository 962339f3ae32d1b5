"""Random forests of many folds in one job: a task grows a few whole trees from the bin numbers of a fold's rows.

The model is MLlib's: per tree every row counts a Poisson(1) number of times, per node the square root of the number of features
is drawn, of at most 32 bins each, and the split with the largest decrease of the weighted Gini impurity is taken until a node is
pure, no split decreases it or the depth is reached. MLlib moves the histograms of every node of a level between its tasks, 15 KB a
node, and a forest of unlimited depth has a node for every few rows. Here only bin numbers and nodes are moved. Edges of bins are
quantiles of all rows; draws follow the seed, the fold's position and the tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.operators.boosting import bin_edges, binned_rows, packed_rows
from hostloom.session import ship_package, stored

BINS = 32  # MLlib's
FOREST_ROWS = 2_000_000  # rows of a table up to which a task takes those of a fold; beyond, MLlib's forests are used
BLOCKS = 16  # groups of trees of a fold
_CELLS = 1 << 21  # sums looked through at once
_LEAST_GAIN = 1e-12

NODES = "fold int, tree int, node int, feature int, threshold double, left int, right int, stats array<double>"


def best_gini(sums: np.ndarray):
    """Best (gain, place among the drawn features, bin) of every node from its sums (node, drawn feature, bin, class).

    The gain is the decrease of the impurity; a split that leaves one side without weight is not allowed.
    """
    nodes, drawn, bins, _ = sums.shape
    left = sums.cumsum(axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    whole, on_left = total.sum(axis=1)[:, None, None], left.sum(axis=3)
    on_right = whole - on_left
    allowed = (on_left > 1e-9 * whole) & (on_right > 1e-9 * whole)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (left**2).sum(axis=3) / on_left + (right**2).sum(axis=3) / on_right
    gain = np.where(allowed, kept / whole - ((total**2).sum(axis=1))[:, None, None] / whole**2, 0).reshape(nodes, -1)
    best = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1)  # of gains that differ in their last digits the first
    return gain[np.arange(nodes), best], best // (bins - 1), best % (bins - 1)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, drawn: int, rng: np.random.Generator):
    """One tree, level by level: (feature or -1, bin, left, right, weights of classes) of its nodes, the root first."""
    width = bins.shape[1]
    row, slot, slots, used, out = np.arange(len(y)), np.zeros(len(y), np.int64), 1, 1, []
    for level in range(depth + 1):
        stats = np.bincount(slot * classes + y[row], weight[row], slots * classes).reshape(slots, classes)
        feature, at = np.full(slots, -1), np.zeros(slots, np.int64)
        ends = np.cumsum(np.bincount(slot, minlength=slots))
        open_ = np.flatnonzero((stats > 0).sum(axis=1) > 1) if level < depth else np.zeros(0, np.int64)
        step = max(_CELLS // (drawn * BINS * classes), 1)
        for first in range(0, len(open_), step):
            some = open_[first : first + step]
            picked = np.sort(rng.random((len(some), width)).argpartition(drawn - 1, axis=1)[:, :drawn], axis=1)
            # Rows are in the order of their slots.
            number = np.full(slots, -1)
            number[some] = np.arange(len(some))
            there = np.arange(ends[some[0] - 1] if some[0] else 0, ends[some[-1]])
            there = there[number[slot[there]] >= 0]
            own, rows = number[slot[there]], row[there]
            key = own[:, None] * drawn + np.arange(drawn)
            key = (key * BINS + bins[rows[:, None], picked[own]]) * classes + y[rows][:, None]
            sums = np.bincount(key.ravel(), np.repeat(weight[rows], drawn), len(some) * drawn * BINS * classes)
            gain, place, cut = best_gini(sums.reshape(len(some), drawn, BINS, classes))
            taken = gain > _LEAST_GAIN
            feature[some[taken]] = picked[np.arange(len(some)), place][taken]
            at[some[taken]] = cut[taken]
        split = feature >= 0
        left = np.where(split, used + 2 * (np.cumsum(split) - split), -1)
        out.append((feature, at, left, np.where(split, left + 1, -1), stats))
        if not split.any():
            break
        used += 2 * int(split.sum())
        go = split[slot]
        row, slot = row[go], slot[go]
        slot = 2 * (np.cumsum(split) - split)[slot] + (bins[row, feature[slot]] > at[slot])
        order = np.argsort(slot, kind="stable")
        row, slot, slots = row[order], slot[order], 2 * int(split.sum())
    return [np.concatenate(c) for c in zip(*out)]


def fit(rows: DataFrame, folds: Sequence[int], trees: int, depth: int, weighted: bool, seed: int, key: Sequence[str]) -> DataFrame:
    """The nodes (``NODES``) of a forest per fold, fitted on the rows of the other folds; stored."""
    ship_package(rows.sparkSession)
    edges = bin_edges(rows, BINS)
    width, blocks = len(edges), min(BLOCKS, trees)
    drawn = ceil(sqrt(width)) if trees > 1 else width
    weight = F.col("weight") if weighted else F.lit(1.0)
    plain = rows.select(*key, "fold", "y", weight.alias("weight"), vector_to_array("features").alias("features"))
    training = F.filter(F.array(*map(F.lit, folds)), lambda f: f != F.col("fold"))
    each = binned_rows(plain, edges).withColumn("out", F.explode(training))
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("fold")

    def run(table: pa.Table) -> pa.Table:
        fold, block = (table.column(c)[0].as_py() for c in ("out", "block"))
        table = table.sort_by([(c, "ascending") for c in (*key, "y")])
        bins, y = packed_rows(table.column("bins"), width), table.column("y").to_numpy().astype(np.int64)
        weight, classes, parts = table.column("weight").to_numpy(), int(y.max()) + 1, []
        for tree in range(block, trees, blocks):
            rng = np.random.default_rng([seed, fold, tree])
            times = rng.poisson(1.0, len(y)) if trees > 1 else np.ones(len(y), np.int64)
            own = np.flatnonzero((times > 0) & (weight > 0))
            feature, at, left, right, stats = grow(bins[own], y[own], (weight * times)[own], classes, depth, drawn, rng)
            threshold = np.zeros(len(feature))
            for k, limits in enumerate(edges):
                here = feature == k
                threshold[here] = limits[at[here]]
            count = len(feature)
            columns = [np.full(count, fold), np.full(count, tree), np.arange(count), feature, threshold, left, right]
            types = [pa.int32()] * 4 + [pa.float64()] + [pa.int32()] * 2
            arrays = [pa.array(c).cast(t) for c, t in zip(columns, types)]
            offsets = pa.array(np.arange(count + 1) * classes, pa.int32())
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(stats.ravel())))
            parts.append(pa.table(arrays, names=[part.split()[0] for part in NODES.split(", ")]))
        return pa.concat_tables(parts)

    # Many more tasks than groups, so that few of them share one; a given number is not coalesced.
    dealt = each.repartition(4 * blocks * len(folds), "out", "block")
    return stored(dealt.groupBy("out", "block").applyInArrow(run, NODES), "forest-nodes")
