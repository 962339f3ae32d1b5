"""Predictions of MLlib's trees and forests at several depths from one fit.

Trees grow level by level, and no split looks at the depth that is allowed: the first levels of a deep tree are the tree
of a smaller depth. MLlib then merges leaves that predict the same class, which depends on the depth and is repeated here. A
forest draws its features node by node from the seed; as long as the nodes of a level fit MLlib's memory for one pass, its
shallower forest draws the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.operators.boosting import SCORED_ROWS
from hostloom.session import new_table_path, ship_package

_ENTRIES = 1 << 21


def node_table(model, spark) -> DataFrame:
    """(tree, node, feature or -1, threshold, left, right, stats) of a fitted tree or forest."""
    path = new_table_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    forest = "nodeData" in saved.columns
    tree, rows = ("treeID", "nodeData.") if forest else (F.lit(0), "")
    feature = F.when(F.col(f"{rows}leftChild") < 0, -1).otherwise(F.col(f"{rows}split.featureIndex"))
    return saved.select(
        F.col(tree).alias("tree") if forest else tree.alias("tree"),
        F.col(f"{rows}id").alias("node"),
        feature.cast("int").alias("feature"),
        F.get(F.col(f"{rows}split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col(f"{rows}leftChild").alias("left"),
        F.col(f"{rows}rightChild").alias("right"),
        F.col(f"{rows}impurityStats").alias("stats"),
    )


class Levels:
    """The nodes of all trees of a model in arrays, with their level."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
        node, self.feature, self.threshold = (nodes.column(c).to_numpy() for c in ("node", "feature", "threshold"))
        self.roots = np.flatnonzero(node == 0)
        base = np.repeat(self.roots, np.diff(np.append(self.roots, len(node))))
        self.left, self.right = (base + nodes.column(c).to_numpy() for c in ("left", "right"))
        flat = [c.flatten().to_numpy() for c in nodes.column("stats").chunks]
        self.stats = np.concatenate(flat).reshape(len(node), -1)
        self.predicted = self.stats.argmax(axis=1)
        self.levels = [self.roots]
        while len(inner := self.levels[-1][self.feature[self.levels[-1]] >= 0]):
            self.levels.append(np.concatenate([self.left[inner], self.right[inner]]))
        # A forest's trees vote by shares of classes.
        total = self.stats.sum(axis=1, keepdims=True)
        self.votes = self.stats / np.where(total > 0, total, 1) if len(self.roots) > 1 else self.stats

    def leaf_of(self, depth: int) -> np.ndarray:
        """For every node down to ``depth`` the leaf that holds its rows in the model of that depth."""
        stop = self.feature < 0
        if depth < len(self.levels):
            stop[self.levels[depth]] = True
        for nodes in reversed(self.levels[:depth]):
            inner = nodes[self.feature[nodes] >= 0]
            left, right = self.left[inner], self.right[inner]
            stop[inner] = stop[left] & stop[right] & (self.predicted[left] == self.predicted[right])
        leaf = np.arange(len(stop))
        for nodes in self.levels[:depth]:
            inner = nodes[self.feature[nodes] >= 0]
            for child in (self.left[inner], self.right[inner]):
                leaf[child] = np.where(stop[inner] | (leaf[inner] != inner), leaf[inner], child)
        return leaf

    def predict(self, values: np.ndarray, depths: Sequence[int]) -> list[np.ndarray]:
        """The class of every row at every depth of rising ``depths``."""
        leaves = [self.leaf_of(d) for d in depths]
        out = [np.zeros(len(values), np.int64) for _ in depths]
        step = max(_ENTRIES // len(self.roots), 1)
        for start in range(0, len(values), step):
            part = values[start : start + step]
            at, level = np.tile(self.roots, len(part)), 0
            inner = np.flatnonzero(self.feature[at] >= 0)
            for k, depth in enumerate(depths):
                while level < depth and len(inner):
                    node = at[inner]
                    low = part[inner // len(self.roots), self.feature[node]] <= self.threshold[node]
                    at[inner] = node = np.where(low, self.left[node], self.right[node])
                    inner = inner[self.feature[node] >= 0]
                    level += 1
                votes = np.zeros((len(part), self.votes.shape[1]))
                for leaf in leaves[k][at].reshape(len(part), -1).T:
                    votes += self.votes[leaf]
                out[k][start : start + step] = votes.argmax(axis=1)
        return out


def predict_depths(model, rows: DataFrame, depths: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """depth, the columns ``keep``, and ``y_pred`` of every row at every depth; the model is at least as deep as the last."""
    return predict_nodes(node_table(model, rows.sparkSession), rows, depths, keep)


def predict_nodes(table: DataFrame, rows: DataFrame, depths: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``predict_depths`` of a model that is given as its nodes."""
    depths = sorted(depths)
    ship_package(rows.sparkSession)
    blocks = -(-rows.count() // SCORED_ROWS) or 1
    block = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block")
    dealt = rows.select(*keep, vector_to_array("features").alias("features"), block)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    spread = table.withColumn("block", every)
    kept = dealt.select(*keep).schema
    names = kept.names

    def run(nodes: pa.Table, part: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({"depth": pa.array([], pa.int32())} | {n: part.column(n) for n in names} | {"y_pred": pa.array([], pa.int64())})
        flat = [c.flatten().to_numpy() for c in part.column("features").chunks]
        values = np.concatenate(flat).reshape(part.num_rows, -1)
        found = Levels(nodes).predict(values, depths)
        tables = []
        for depth, predicted in zip(depths, found):
            own = part.select(names).add_column(0, "depth", pa.array([depth] * part.num_rows, pa.int32()))
            tables.append(own.append_column("y_pred", pa.array(predicted)))
        return pa.concat_tables(tables)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    return spread.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, f"depth int, {schema}, y_pred bigint")
