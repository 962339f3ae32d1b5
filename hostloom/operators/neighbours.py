"""Nearest neighbours under the cosine distance, and a flat layout that keeps them close.

The graph comes from a forest of random projections: every level of every tree halves its nodes at the median of a random
projection, one aggregate for all nodes of all trees, until a node is small enough for one task, which halves it on until a
leaf holds at most ``leaf`` rows; rows meet in leaves only, so work grows with the rows and no pair outside a leaf is formed.
The layout moves all points together, epoch by epoch, by joins of edges with positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from hostloom.operators.dataset import stratified_rank
from hostloom.session import ship_package, stored

# Moves copies apart, so that a median halves them as well.
_JITTER = 1e-9
# Distances are kept to what single precision tells apart.
_DECIMALS = 6
# Nodes of up to so many rows are halved further inside one task.
_BLOCK_ROWS = 1 << 14


@dataclass(frozen=True)
class Forest:
    """``accuracy`` is that of the medians: ranks are exact in nodes of up to half as many rows, beyond that within a
    share of 1 / accuracy."""

    trees: int = 16
    leaf: int = 128
    seed: int = 0
    accuracy: int = 10_000


@dataclass(frozen=True)
class Layout:
    epochs: int = 40
    rate: float = 0.5
    negatives: int = 5
    seed: int = 0


def _hashed(*parts) -> Column:
    """A number in [-1, 1) from the parts."""
    return F.xxhash64(*parts).cast("double") / 2.0**63


def unit_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, unit): vectors of length 1 in single precision. A vector of length 0 stays as it is; rows whose vector is null
    or has a null, infinite or undefined component are left out. Rows that share a key count as one, the smallest vector."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    whole = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), length.alias("length"))
    whole = whole.filter(F.col("length") < float("inf"))
    divisor = F.when(F.col("length") > 0, F.col("length")).otherwise(F.lit(1.0))
    units = whole.select("key", F.transform("vector", lambda x: (x / divisor).cast("float")).alias("unit"))
    return units.groupBy("key").agg(F.min("unit").alias("unit"))


def _directions(forest: Forest, levels: int, components: int) -> np.ndarray:
    """(component, tree, level): what the rows are projected on."""
    drawn = np.random.default_rng(forest.seed).standard_normal((components, forest.trees * levels))
    return drawn.reshape(components, forest.trees, levels)


def _projected(points: DataFrame, forest: Forest, levels: int, upper: int) -> DataFrame:
    """(key, tree, node, along): the row's projections, one per upper level of the tree."""
    trees = forest.trees

    def project(batches):
        directions = None
        for batch in batches:
            if not len(batch):
                continue
            units = np.stack(batch["unit"].to_numpy()).astype("float64")
            if directions is None:
                directions = _directions(forest, levels, units.shape[1])[:, :, :upper].reshape(-1, trees * upper)
            along = (units @ directions).reshape(len(units) * trees, upper)
            yield pd.DataFrame(
                {"key": np.repeat(batch["key"].to_numpy(), trees), "tree": np.tile(np.arange(trees), len(units)), "along": list(along)}
            )

    kind = points.schema["key"].dataType.simpleString()
    found = points.mapInPandas(project, f"key {kind}, tree int, along array<double>")
    return found.withColumn("node", F.lit(0).cast("bigint"))


def _jitter(level: int) -> Column:
    return _hashed("key", "tree", F.lit(level)) * _JITTER


def _blocks(points: DataFrame, forest: Forest) -> tuple[GroupedData, int]:
    """Rows (key, tree, node, unit, jitter) by the nodes that one task halves further, and the levels of a tree.

    Levels above are one aggregate and one join each; a level's projections are dropped with it. Medians are small beside
    the rows; Spark broadcasts them while their size allows it. ``jitter`` has one number per level left.
    """
    count = points.count()
    levels = max(0, ceil(log2(count / forest.leaf))) if count else 0
    upper = max(0, levels - int(log2(max(1, _BLOCK_ROWS // forest.leaf))))
    if upper:
        nodes = stored(_projected(points, forest, levels, upper), "tree-nodes")
    else:
        tree = F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")
        nodes = points.select("key", tree, F.lit(0).cast("bigint").alias("node"))
    for level in range(upper):
        placed = nodes.withColumn("place", F.get("along", F.lit(0)) + _jitter(level))
        middle = placed.groupBy("tree", "node").agg(F.percentile_approx("place", 0.5, forest.accuracy).alias("middle"))
        beyond = (F.col("place") > F.col("middle")).cast("bigint")
        split = placed.join(middle, ["tree", "node"])
        left = [F.slice("along", 2, upper).alias("along")] if level + 1 < upper else []
        nodes = stored(split.select("key", "tree", (F.col("node") * 2 + beyond).alias("node"), *left), "tree-nodes")
    jitter = F.array(*[_jitter(level) for level in range(upper, levels)]).cast("array<double>").alias("jitter")
    met = nodes.join(points, "key").select("key", "tree", "node", "unit", jitter)
    return met.groupBy("tree", "node"), levels


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy().astype("float64").reshape(rows, -1)


def _halved(block: pa.Table, units: np.ndarray, forest: Forest, levels: int) -> np.ndarray:
    """The leaf of every row of a block: its node, halved at exact medians of the levels left."""
    jitter = _matrix(block.column("jitter"), len(units)) if len(units) else np.zeros((0, 0))
    left = jitter.shape[1]
    tree, node = block.column("tree")[0].as_py(), np.full(len(units), block.column("node")[0].as_py())
    place = units @ _directions(forest, levels, units.shape[1])[:, tree, levels - left :] + jitter
    for level in range(left):
        order = np.lexsort((place[:, level], node))
        _, first, size = np.unique(node[order], return_index=True, return_counts=True)
        middle = place[order[first + (size - 1) // 2], level]
        beyond = np.empty(len(node), bool)
        beyond[order] = place[order, level] > np.repeat(middle, size)
        node = node * 2 + beyond
    return node


def leaves(points: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """(key, tree, node): the leaf of every row of ``unit_vectors`` in every tree.

    All nodes are halved as often as the number of rows asks, so that a leaf holds about ``leaf`` rows at most, however
    many copies there are.
    """
    blocks, levels = _blocks(points, forest)

    def run(block: pa.Table) -> pa.Table:
        node = _halved(block, _matrix(block.column("unit"), block.num_rows), forest, levels)
        return block.select(["key", "tree"]).append_column("node", pa.array(node))

    kind = points.schema["key"].dataType.simpleString()
    return blocks.applyInArrow(run, f"key {kind}, tree int, node bigint")


def _nearest_in_leaves(k: int, forest: Forest, levels: int):
    def search(block: pa.Table) -> pa.Table:
        block = block.sort_by("key").combine_chunks()
        units = _matrix(block.column("unit"), block.num_rows)
        node = _halved(block, units, forest, levels)
        order = np.argsort(node, kind="stable")  # keys ascend within a leaf
        rows, best, near = [order[:0]], [order[:0]], [units[:0, 0]]
        counts = np.zeros(block.num_rows, np.int32)
        for leaf in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            distance = np.round(np.maximum(1 - units[leaf] @ units[leaf].T, 0), _DECIMALS)
            np.fill_diagonal(distance, np.inf)
            count = min(k, len(leaf) - 1)
            found = np.argsort(distance, axis=1, kind="stable")[:, :count]
            counts[leaf] = count
            rows.append(leaf)
            best.append(leaf[found].ravel())
            near.append(np.take_along_axis(distance, found, axis=1).ravel())
        rows = np.concatenate(rows)
        ends = pa.array(np.append(0, np.cumsum(counts[rows])).astype(np.int32))
        keys = block.column("key").combine_chunks()
        neighbours = pa.ListArray.from_arrays(ends, keys.take(pa.array(np.concatenate(best))))
        distances = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(near)))
        return pa.table({"key": keys.take(pa.array(rows)), "neighbours": neighbours, "distances": distances})

    return search


def neighbour_graph(rows: DataFrame, key: str, vector: str, k: int = 15, forest: Forest = Forest()) -> DataFrame:
    """The ``k`` nearest other rows of every row: (key, rank, neighbour, distance), rank from 1.

    ``key`` names the rows; those that share one, say an address listed twice, count as one row and are no neighbours of
    themselves. Distance is 1 - cosine to six decimals, 1 to a vector of length 0; ties go to the smaller key.
    The neighbours are the nearest among those that share a leaf in some tree; more trees or larger leaves find more.
    A table of at most ``leaf`` rows gives exact neighbours, one row or none gives no row.
    """
    ship_package(rows.sparkSession)
    points = stored(unit_vectors(rows, key, vector), "units")
    kind = points.schema["key"].dataType.simpleString()
    blocks, levels = _blocks(points, forest)
    schema = f"key {kind}, neighbours array<{kind}>, distances array<double>"
    found = blocks.applyInArrow(_nearest_in_leaves(k, forest, levels), schema)
    # One exchange: grouping and window both follow the key. A row's links of a tree move as one row.
    link = F.explode(F.arrays_zip("neighbours", "distances")).alias("link")
    met = found.repartition("key").select("key", link)
    met = met.select("key", F.col("link.neighbours").alias("neighbour"), F.col("link.distances").alias("distance"))
    best = met.groupBy("key", "neighbour").agg(F.min("distance").alias("distance"))
    near = Window.partitionBy("key").orderBy("distance", "neighbour")
    ranked = best.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "rank", "neighbour", "distance")


def neighbour_weights(graph: DataFrame, key: str) -> DataFrame:
    """Both directions of every link with its weight: (key, neighbour, weight).

    A row's nearest neighbour weighs 1, the others fall off exponentially beyond its distance; the width of a row is such
    that its weights sum to log2 of their number. The two weights of a pair join as probabilities do.
    """
    own = graph.groupBy(key).agg(F.collect_list(F.struct("neighbour", "distance")).alias("links"))
    own = own.withColumn("nearest", F.array_min(F.transform("links", lambda link: link["distance"])))
    excess = F.transform("links", lambda link: link["distance"] - F.col("nearest"))
    own = own.withColumn("excess", excess).withColumn("target", F.log2(F.size("links")))

    def halved(bounds: Column, _: Column) -> Column:
        middle = (bounds["low"] + bounds["high"]) / 2
        total = F.aggregate("excess", F.lit(0.0), lambda total, x: total + F.exp(-x / middle))
        wide = total > F.col("target")
        return F.struct(
            F.when(wide, bounds["low"]).otherwise(middle).alias("low"), F.when(wide, middle).otherwise(bounds["high"]).alias("high")
        )

    start = F.struct(F.lit(0.0).alias("low"), F.lit(64.0).alias("high"))
    width = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halved)["high"]
    links = own.withColumn("width", F.greatest(width, F.lit(1e-6))).select(
        key, "nearest", "width", F.explode("links").alias("link")
    )
    weight = F.exp(-(F.col("link.distance") - F.col("nearest")) / F.col("width"))
    one_way = links.select(key, F.col("link.neighbour").alias("neighbour"), weight.alias("weight"))
    turned = one_way.select(F.col("neighbour").alias(key), F.col(key).alias("neighbour"), "weight")
    both = one_way.unionAll(turned).groupBy(key, "neighbour")
    return both.agg((1 - F.product(1 - F.col("weight"))).alias("weight"))


def _clipped(force: Column) -> Column:
    return F.greatest(F.lit(-4.0), F.least(F.lit(4.0), force))


def neighbour_layout(start: DataFrame, weights: DataFrame, key: str, layout: Layout = Layout()) -> DataFrame:
    """Positions (key, x, y) in which linked rows lie close, from first positions ``start`` (key, x, y).

    In every epoch each point moves by the mean pull of its links and the push of a few points drawn by hash, with a
    falling rate; closeness of two points is 1 / (1 + d^2). All moves of an epoch are one sum per point, so positions do not
    depend on partitioning but for the last digits. Points without a link are only pushed. Rows of ``start`` that share a key
    are one point, at the smallest of their places.
    """
    points = start.groupBy(key).agg(F.min(F.struct("x", "y")).alias("place")).select(key, "place.x", "place.y")
    points = stored(points.withColumn("all", F.lit(0)), "start")
    ranked = stratified_rank(points, "all", layout.seed, key)
    span = points.select(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).first()[0] or 1.0
    apart = [F.col(axis) * (10.0 / span) + _hashed(key, F.lit(axis)) * 1e-3 for axis in ("x", "y")]
    numbered = stored(
        ranked.select(key, (F.col("rank") - 1).cast("bigint").alias("no"), apart[0].alias("x"), apart[1].alias("y")), "numbered"
    )
    count = numbered.count()
    numbers = numbered.select(key, "no")
    other = numbers.select(F.col(key).alias("neighbour"), F.col("no").alias("to"))
    linked = weights.join(numbers, key).join(other, "neighbour").select("no", "to", "weight")
    degree = linked.groupBy("no").agg(F.sum("weight").alias("degree"))
    links = stored(linked.join(degree, "no").select("no", "to", (F.col("weight") / F.col("degree")).alias("pull")), "links")
    places = numbered.select("no", "x", "y")
    for epoch in range(layout.epochs):
        drawn = F.explode(F.sequence(F.lit(0), F.lit(layout.negatives - 1))).alias("draw")
        partner = F.pmod(F.xxhash64("no", "draw", F.lit(layout.seed), F.lit(epoch)), F.lit(count))
        pushed = places.select("no", drawn).select("no", partner.alias("to"), F.lit(None).cast("double").alias("pull"))
        there = places.select(F.col("no").alias("to"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
        pairs = links.unionAll(pushed).join(there, "to").join(places, "no")
        pairs = pairs.withColumn("apart", (F.col("x") - F.col("to_x")) ** 2 + (F.col("y") - F.col("to_y")) ** 2)
        push = 2 / ((0.001 + F.col("apart")) * (1 + F.col("apart")))
        pull = -2 * F.col("pull") / (1 + F.col("apart"))
        force = F.when(F.col("pull").isNull(), push).otherwise(pull)
        moves = [F.sum(_clipped(force * (F.col(a) - F.col(f"to_{a}")))).alias(f"by_{a}") for a in ("x", "y")]
        rate = layout.rate * (1 - epoch / layout.epochs)
        moved = pairs.groupBy("no", "x", "y").agg(*moves)
        places = stored(moved.select("no", *[(F.col(a) + rate * F.col(f"by_{a}")).alias(a) for a in ("x", "y")]), "places")
    return numbers.join(places, "no").select(key, "x", "y")
