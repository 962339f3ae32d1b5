"""Hard negatives by exact inner products of packed integers.

Several candidates' components lie in separate fields of one 64-bit integer (each with a bias that makes it positive),
so that one multiplication per anchor component serves all of them. Summed over the components, a field holds its
candidate's product, the bias times the anchor's sum and nothing else; with a constant added that makes every field
positive, the fields are read back exactly. Arithmetic modulo 2**64 is enough, as only the final value has to fit, and its
fields are as wide as the largest possible product of the candidates and anchors that meet (by their lengths).

Anchors meet all rows in cells of bounded size: rows and anchors are dealt into blocks by a hash of their row number, and
each cell, one block of each, is one group of a co-grouping. Nothing is broadcast and no label, vector or anchor is
hot: a label with a third of all rows has as many blocks as its rows need.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.vectors import matrix, scaled, usable
from hostloom.session import stored

POSITIVES = 5
NEGATIVES = 3
# Bounds of a negative's score in hundredths of the positive's.
LOW, HIGH = 50, 95
CELL_ROWS, CELL_ANCHORS = 1 << 16, 1 << 15
LEAST_CELL = 1 << 10
MOST_TASKS = 1 << 16
_BLOCK = 1 << 16
_NONE = np.iinfo(np.int64).min


class Packed:
    """Candidates (rows of integers) packed for products with anchors no longer than ``reach`` (squared length)."""

    def __init__(self, candidates: np.ndarray, reach: int):
        self.count, dimension = candidates.shape
        longest = int(np.einsum("ij,ij->i", candidates, candidates).max(initial=0))
        self.limit = math.isqrt(longest * reach) + 1  # no product is larger in size
        self.width = (2 * self.limit).bit_length()
        if self.width > 64:
            raise ValueError("products of these vectors do not fit 64 bits")
        self.fields = max(64 // self.width, 1)
        self.words = -(-self.count // self.fields)
        self.bias = int(-candidates.min(initial=0))
        self.packed = np.zeros((dimension, self.words), np.uint64)
        for field in range(self.fields):
            part = (candidates[field * self.words : (field + 1) * self.words] + self.bias).T.astype(np.uint64)
            self.packed[:, : part.shape[1]] |= part << np.uint64(field * self.width) if field else part

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of every anchor with every candidate."""
        factors = anchors.astype(np.uint64)
        ones = sum(1 << (field * self.width) for field in range(self.fields))
        # One field per candidate: its product + bias * sum(anchor); this makes it product + limit.
        lift = [((self.limit - self.bias * int(total)) * ones) % 2**64 for total in anchors.sum(1)]
        sums = factors @ self.packed  # integers modulo 2**64
        sums += np.array(lift, np.uint64)[:, None]
        out = np.empty((len(anchors), self.fields * self.words), np.int64)
        mask = np.uint64((1 << self.width) - 1)
        for field in range(self.fields):
            part = out[:, field * self.words : (field + 1) * self.words]
            np.subtract(((sums >> np.uint64(field * self.width)) & mask).view(np.int64), self.limit, out=part)
        return out[:, : self.count]


def _best(scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and score of the ``count`` largest entries of each row (ties: first place); overwrites ``scores``.

    Entries of the least integer are no candidates.
    """
    every = np.arange(len(scores))
    found = []
    for _ in range(min(count, scores.shape[1])):
        place = scores.argmax(1)
        value = scores[every, place]
        there = value > _NONE
        found.append((every[there], place[there], value[there]))
        scores[every, place] = _NONE
    return tuple(np.concatenate(columns) for columns in zip(*found)) if found else (every[:0], every[:0], every[:0])


def _blocks(anchors: pa.Table, rows: pa.Table):
    """Sorted candidates of a cell, and slices of its anchors with the scores of all candidates."""
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
    own, other = matrix(anchors.column("vector")), matrix(rows.column("vector"))
    width = max(own.shape[1], other.shape[1])
    own, other = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (own, other))
    packed = Packed(other, int(np.einsum("ij,ij->i", own, own).max(initial=0)))
    step = max(_BLOCK // max(packed.words, 1), 1)
    for start in range(0, len(own), step):
        yield rows, anchors.slice(start, step), packed.scores(own[start : start + step])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _joined(found: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables(found) if found else schema.empty_table()


_POSITIVE = pa.schema(
    [("row", pa.int64()), ("positive_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]
)
_NEGATIVE = pa.schema(
    [("row", pa.int64()), ("number", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]
)


def _positives(count: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            for rows, part, scores in _blocks(anchors, rows):
                scores[_column(part, "row")[:, None] == _column(rows, "row")] = _NONE
                anchor, place, score = _best(scores, count)
                there = rows.take(place)
                columns = [part.column("row").take(anchor), there.column("row"), there.column("vec_id"), score]
                found.append(pa.table(columns, schema=_POSITIVE))
        return _joined(found, _POSITIVE)

    return run


def _negatives(count: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            for rows, part, scores in _blocks(anchors, rows):
                scores[_column(part, "label")[:, None] == _column(rows, "label")] = _NONE
                limits = matrix(part.column("limits"))  # scores of up to POSITIVES positives, 0 where there are fewer
                sizes = np.diff(part.column("limits").combine_chunks().offsets.to_numpy())
                for number in range(limits.shape[1]):
                    # 100 s between low * p and high * p, in whole numbers.
                    least, most = -(-low * limits[:, number] // 100), high * limits[:, number] // 100
                    least = np.where(sizes > number, np.maximum(least, _NONE + 1), 1)
                    most = np.where(sizes > number, most, 0)
                    fitting = (scores >= least[:, None]) & (scores <= most[:, None])
                    anchor, place, score = _best(np.where(fitting, scores, _NONE), count)
                    numbers = pa.array(np.full(len(anchor), number, np.int32))
                    columns = [part.column("row").take(anchor), numbers, rows.column("vec_id").take(place), score]
                    found.append(pa.table(columns, schema=_NEGATIVE))
        return _joined(found, _NEGATIVE)

    return run


def _meet(anchors: DataFrame, rows: DataFrame, parts: list[str], run, schema: str, cell: tuple[int, int]) -> DataFrame:
    """``run`` on every cell: a block of anchors and a block of rows that agree in the columns ``parts``."""
    rows = rows.toDF(*rows.columns)  # names of their own, as both sides come from one table
    blocks = {"row_blocks": F.ceil(F.col("n_rows") / cell[0]), "anchor_blocks": F.ceil(F.col("n_anchors") / cell[1])}
    n_rows, n_anchors = F.count("*").alias("n_rows"), F.count("*").alias("n_anchors")
    if parts:
        sizes = rows.groupBy(*parts).agg(n_rows).join(anchors.groupBy(*parts).agg(n_anchors), parts)
        sizes = stored(sizes.select(*parts, *(b.alias(name) for name, b in blocks.items())), "negative-blocks")
        cells = sizes.agg(F.sum(F.col("row_blocks") * F.col("anchor_blocks"))).first()[0] or 1
    else:
        counts = {name: -(-table.count() // size) for name, table, size in zip(blocks, (rows, anchors), cell)}
        cells = max(math.prod(counts.values()), 1)
    tasks = min(cells, MOST_TASKS)

    def dealt(table, blocks, others, block, other):
        with_sizes = table.join(sizes, parts) if parts else table.withColumns({n: F.lit(c) for n, c in counts.items()})
        own = F.pmod(F.xxhash64("row"), F.col(blocks).cast("bigint")).alias(block)
        every = F.sequence(F.lit(0).cast("bigint"), F.col(others).cast("bigint") - 1)
        dealt = with_sizes.filter(F.col(others) > 0).select(*table.columns, own, F.explode(every).alias(other))
        return dealt.repartition(tasks, *keys)

    keys = (*parts, "row_block", "anchor_block")
    left = dealt(anchors, "anchor_blocks", "row_blocks", "anchor_block", "row_block")
    right = dealt(rows, "row_blocks", "anchor_blocks", "row_block", "anchor_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: str = "vec_id % 50 = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    cell: tuple[int, int] | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its first ``positives`` other rows of its label by score, its negatives for each of them the
    first ``negatives`` rows of other labels with ``low`` * positive <= 100 * score <= ``high`` * positive. Scores are inner
    products; equal scores go by vec_id (a null id last). Rows without a label or with a null or non-finite vector take
    no part. A vec_id may repeat: each row is an anchor, a positive or a negative of its own. Components that the shorter
    of two vectors lacks count as 0. Anchors without positives, and positives without negatives, give no rows.
    """
    rows = embeddings.filter(usable(F.col("embedding"))).filter("label is not null")
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        scaled(F.col("embedding")).alias("vector"),
    )
    rows = stored(rows, "negative-rows")
    if cell is None:
        tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
        cell = (min(max(-(-rows.count() // tasks), LEAST_CELL), CELL_ROWS), CELL_ANCHORS)
    anchors = rows.filter(is_anchor)
    near = _meet(
        anchors.select("row", "label", "vector"),
        rows,
        ["label"],
        _positives(positives),
        "row bigint, positive_row bigint, positive_id bigint, positive_score bigint",
        cell,
    )
    order = (F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_row")
    near = near.withColumn("number", F.row_number().over(Window.partitionBy("row").orderBy(*order)) - 1)
    near = stored(near.filter(F.col("number") < positives), "negative-positives")
    limits = F.transform(F.sort_array(F.collect_list(F.struct("number", "positive_score"))), lambda p: p["positive_score"])
    limited = anchors.join(near.groupBy("row").agg(limits.alias("limits")), "row")
    far = _meet(
        limited.select("row", "label", "vector", "limits"),
        rows,
        [],
        _negatives(negatives, low, high),
        "row bigint, number int, negative_id bigint, negative_score bigint",
        cell,
    )
    order = (F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    rank = F.row_number().over(Window.partitionBy("row", "number").orderBy(*order))
    far = far.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return (
        far.join(near, ["row", "number"])
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def relabelled(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Rows whose vec_id is divisible by ``every`` get the next of ``labels`` labels."""
    changed = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", changed.alias("label"))
