"""Centroid clustering of integer vectors with bounds by Ptolemy's inequality.

For a vector o, a centroid q and two pivots p and s, |d(o,p) d(q,s) - d(o,s) d(q,p)| is at most d(o,q) d(p,s). The
distances of every vector to a few fixed pivots are computed once and stored with the vectors, so that each round gets
lower bounds on all distances from centroid-to-pivot distances alone. Bounds are rounded down; a centroid whose bound
exceeds an exact distance already seen is out, and all others are compared exactly, in integers.

Each round is one job over the stored vectors: tasks add up their vectors per centroid, Spark adds the tasks' sums, and
only the sums of the centroids (their number times the dimension) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.vectors import matrix, scaled, usable
from hostloom.session import stored

DIMENSION = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 6
SEED = 2
# Relative error allowed for in bounds; that of a few double operations is below 1e-15.
SLACK = 1e-14
_ROWS = 2048


def kept_vectors(embeddings: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """vec_id, vector of the rows whose embedding has exactly ``dimension`` finite components; vec_id may be null."""
    vector = F.col("embedding")
    kept = usable(vector) & (F.size(vector) == dimension)
    return embeddings.filter(kept).select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(vector).alias("vector"))


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and id, in that order; rows without an id come last.

    Rows with one id are ordered by their components. Fewer rows than ``count`` give fewer centroids.
    """
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(code.asc_nulls_last(), "vector").limit(count).collect()
    return np.array([row["vector"] for row in rows], np.int64)


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points far from each other: each next one is farthest from those before it."""
    chosen = points[:1]
    while 0 < len(chosen) < count:
        nearest = squares(points, chosen).min(1)
        if not nearest.max():
            break
        chosen = np.concatenate([chosen, points[[nearest.argmax()]]])
    return chosen


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of two integer matrices, for a few rows of ``b``."""
    out = np.empty((len(a), len(b)), np.int64)
    for k, row in enumerate(b):
        difference = a - row
        out[:, k] = np.einsum("ij,ij->i", difference, difference)
    return out


class Nearest:
    """Exact nearest centroids by bounds from pivot pairs."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray):
        self.centroids = centroids
        self.to_pivots = np.sqrt(squares(centroids, pivots).astype(float))
        between = np.sqrt(squares(pivots, pivots).astype(float))
        self.pairs = [(p, s, between[p, s]) for p in range(len(pivots)) for s in range(p) if between[p, s] > 0]

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Squared lower bounds on the distances of vectors (given by squared pivot distances) to all centroids."""
        own = np.sqrt(to_pivots.astype(float))
        best = np.zeros((len(own), len(self.centroids)))
        for p, s, between in self.pairs:
            one = own[:, p, None] * self.to_pivots[:, s]
            other = own[:, s, None] * self.to_pivots[:, p]
            gap = np.abs(one - other)
            one += other
            one *= SLACK
            gap -= one
            gap *= (1 - SLACK) / between
            np.maximum(best, gap, out=best)
        return best * best * (1 - SLACK)

    def __call__(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid (ties: smallest number), and exact comparisons made."""
        bounds = self.bounds(to_pivots)
        first = vectors - self.centroids[bounds.argmin(1)]
        limit = np.einsum("ij,ij->i", first, first)
        row, number = np.nonzero(bounds <= limit[:, None] * (1 + SLACK))
        difference = vectors[row] - self.centroids[number]
        distance = np.einsum("ij,ij->i", difference, difference)
        starts = np.searchsorted(row, np.arange(len(vectors)))
        least = np.minimum.reduceat(distance, starts) if len(vectors) else distance
        equal = np.flatnonzero(distance == least[row])
        return number[equal[np.searchsorted(row[equal], np.arange(len(vectors)))]], least, len(row)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            yield part, matrix(part.column("vector"))


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, vector, to_pivots: squared distances to the pivots."""

    def run(batches):
        for part, vector in _parts(batches):
            distances = pa.array(list(squares(vector, pivots)), pa.list_(pa.int64()))
            yield pa.record_batch(
                {"vec_id": part.column("vec_id"), "vector": part.column("vector"), "to_pivots": distances}
            )

    return vectors.mapInArrow(run, "vec_id bigint, vector array<int>, to_pivots array<bigint>")


def moved(vectors: DataFrame, nearest: Nearest) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; one without vectors stays."""
    count, dimension = nearest.centroids.shape

    def run(batches):
        sums, sizes = np.zeros((count, dimension), np.int64), np.zeros(count, np.int64)
        for part, vector in _parts(batches):
            number = nearest(vector, matrix(part.column("to_pivots")))[0]
            order = np.argsort(number, kind="stable")
            there, starts = np.unique(number[order], return_index=True)
            sums[there] += np.add.reduceat(vector[order], starts)
            sizes += np.bincount(number, minlength=count)
        there = np.flatnonzero(sizes)
        columns = [there, sizes[there], pa.array(list(sums[there]), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["number", "size", "sums"])

    added = (
        vectors.mapInArrow(run, "number bigint, size bigint, sums array<bigint>")
        .select("number", "size", F.posexplode("sums").alias("place", "sum"))
        .groupBy("number", "place")
        .agg(F.sum("size").alias("size"), F.sum("sum").alias("sum"))
    )
    centroids = nearest.centroids.copy()
    for row in added.collect():  # one row per centroid and component
        centroids[row["number"], row["place"]] = row["sum"] // row["size"]
    return centroids


def assigned(vectors: DataFrame, nearest: Nearest) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""

    def run(batches):
        for part, vector in _parts(batches):
            number, distance, _ = nearest(vector, matrix(part.column("to_pivots")))
            columns = [part.column("vec_id"), pa.array(number, pa.int32()), distance]
            yield pa.record_batch(columns, ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def clustered(
    embeddings: DataFrame,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    dimension: int = DIMENSION,
    seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of (vec_id, embedding).

    Rows whose embedding is null, has another dimension or a null, NaN or infinite component are left out. Equal rows
    count as often as they occur; a table without kept rows gives no rows.
    """
    vectors = stored(kept_vectors(embeddings, dimension), "centroid-vectors")
    centroids = first_centroids(vectors, count, seed)
    spark = embeddings.sparkSession
    if not len(centroids):
        columns = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint"
        return spark.createDataFrame([], f"{columns}, centroid_sha256 string")
    fixed = spread(centroids, pivots)
    vectors = stored(with_pivots(vectors, fixed), "centroid-pivots")
    for _ in range(rounds):
        centroids = moved(vectors, Nearest(centroids, fixed))
    rows = stored(assigned(vectors, Nearest(centroids, fixed)), "centroid-clusters")
    sums = {r["cluster"]: r["sum"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    total = sum(sums.values())
    texts = [",".join(map(str, c)).encode() for c in centroids]
    described = [(k, sums[k], total, hashlib.sha256(texts[k]).hexdigest()) for k in sums]
    about = spark.createDataFrame(described, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid: the number of centroids is a parameter.
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", *about.columns[1:])
