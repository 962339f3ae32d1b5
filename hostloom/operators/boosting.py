"""Multiclass boosted trees, many models in one job, kept as tables of nodes.

Features are cut into bins at quantiles that Spark aggregates over the whole table. Every training row names the models it
trains (folds, depths, feature sets), and each model is one group of the binned rows: its trees grow level by level from
histograms of first and second derivatives of the softmax loss, the trees of all classes of a round together. Every row of a
model counts. A model of more than ``GROUP_ROWS`` rows is not one group: its rows stay apart in tasks of one barrier stage, which
add up their histograms column by column through the shared folder (``Peers``), and the same trees grow.

A fitted model is rows (model, round, class, node, feature, threshold, gain, cover, left, right, value). Scoring brings
these to blocks of rows; neither rows nor models pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import prod
from time import sleep
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.session import new_table_path, ship_package, stored

BINS = 64
MAX_ROWS: int | None = None  # a bound on the rows of a fit for trials, by a hash of the row; no query sets it
GROUP_ROWS = 200_000  # rows of a model up to which one task fits it
SCORED_ROWS = 1 << 16  # rows of a block scored at once
# The customary settings of second-order boosting.
LEARNING_RATE, L2, LEAST_WEIGHT, LEAST_GAIN = 0.3, 1.0, 1.0, 1e-6
_ENTRIES = 1 << 21
_CACHED = 1 << 17  # sums looked through at once
_EXCHANGED = 1 << 22  # sums added up among tasks at once
_FEW = 400  # entries a node up to which all columns are counted at once, and both children of a node twice as large
_MANY = 4096  # entries a node from which columns are counted jointly
_HASHED = 1 << 30

NODES = "model string, round int, class bigint, node int, feature int, threshold double, gain double, cover double, left int, right int, value double"
_NODES = pa.schema(
    [("model", pa.string()), ("round", pa.int32()), ("class", pa.int64()), ("node", pa.int32())]
    + [("feature", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("cover", pa.float64())]
    + [("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64())]
)


def bin_edges(rows: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the upper edges of its bins but the last: quantiles of ``features`` over all rows."""
    places = [k / bins for k in range(1, bins)]
    values = rows.select(F.posexplode(vector_to_array("features")).alias("feature", "x")).filter(~F.isnan("x"))
    found = values.groupBy("feature").agg(
        F.percentile_approx("x", places, 10_000).alias("edges"), F.max("x").alias("last")
    )
    edges = {r["feature"]: np.unique([e for e in r["edges"] if e < r["last"]]) for r in found.collect()}  # per feature
    return [edges.get(k, np.zeros(0)) for k in range(max(edges, default=-1) + 1)]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix: how many edges lie below each value. NaN counts as the largest."""
    out = np.empty(values.shape, np.uint8)
    for k, limits in enumerate(edges):
        out[:, k] = np.searchsorted(limits, values[:, k])
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Columns:
    """The columns of a matrix of bins, laid out for counting. Columns with one bin allow no split and are left out.

    Where nodes have many rows, several columns are counted at once: their bins are the digits of one number, and each
    column's sums are the margins of the joint ones.
    """

    def __init__(self, bins: np.ndarray, sizes: np.ndarray | None = None):
        """``sizes`` has the number of bins of every column, where ``bins`` are a part of the rows only."""
        if sizes is None:
            sizes = bins.max(axis=0, initial=0).astype(np.int64) + 1
            self.features = np.flatnonzero(bins.min(axis=0, initial=BINS) + 1 < sizes) if len(bins) else np.zeros(0, np.int64)
        else:
            self.features = np.flatnonzero(sizes > 1)
        self.single = [((k,), (int(sizes[f]),), np.ascontiguousarray(bins[:, f])) for k, f in enumerate(self.features)]
        self.matrix = np.ascontiguousarray(bins[:, self.features])
        self.joint, members = [], []
        for k in np.argsort(sizes[self.features], kind="stable").tolist():
            if members and prod(self.single[m][1][0] for m in (*members, k)) > BINS * BINS:
                self.joint.append(self._joined(members))
                members = []
            members.append(k)
        if members:
            self.joint.append(self._joined(members))

    def _joined(self, members: Sequence[int]):
        digits, number = tuple(self.single[m][1][0] for m in members), np.zeros(len(self.single[members[0]][2]), np.uint16)
        for m, size in zip(members, digits):
            number = number * np.uint16(size) + self.single[m][2]
        return tuple(members), digits, number

    def histograms(self, row: np.ndarray | None, slot: np.ndarray, weights: Sequence[np.ndarray], slots: int):
        """Sums of each weight per (slot, column, bin); ``row`` and ``slot`` name the row and the node of every entry.

        Without ``row``, the entries are all rows, once per slot.
        """
        shape = (slots, len(self.features), BINS)
        if row is not None and len(slot) < _FEW * slots:
            key = (self.matrix[row] + (slot[:, None] * shape[1] + np.arange(shape[1])) * BINS).ravel()
            return [np.bincount(key, np.repeat(weight, shape[1]), prod(shape)).reshape(shape) for weight in weights]
        out = [np.zeros(shape) for _ in weights]
        for members, digits, number in self.joint if len(slot) >= _MANY * slots else self.single:
            span = prod(digits)
            key = (number if row is None else number.take(row)).astype(np.intp)
            if row is not None:
                key += slot * span
            for total, weight in zip(out, weights):
                if row is None:
                    sums = np.stack([np.bincount(key, part, span) for part in weight.reshape(slots, len(number))])
                else:
                    sums = np.bincount(key, weight, slots * span)
                sums = sums.reshape(slots, *digits)
                for place, (k, size) in enumerate(zip(members, digits), 1):
                    others = tuple(axis for axis in range(1, sums.ndim) if axis != place)
                    total[:, k, :size] = sums.sum(axis=others) if others else sums
        return out


class Alone:
    """What a task needs of the others if it has all rows of a model: nothing."""

    alone = True

    def add(self, *sums: np.ndarray) -> list[np.ndarray]:
        return list(sums)

    def own(self, count: int) -> tuple[int, int]:
        return 0, count

    def columns(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        return sums

    def best(self, gain: np.ndarray, feature: np.ndarray, at: np.ndarray):
        return gain, feature, at

    def classes(self, y: np.ndarray) -> np.ndarray:
        return np.unique(y)


class Peers:
    """The tasks of a barrier stage, which run at the same time and hold the rows of a model among them.

    Each task adds up the histograms of its own range of columns, and all tell each other their best splits. They do so by a
    file per task and turn in the shared folder: Spark's own calls between barrier tasks take a second each. Sums are
    taken in the order of the tasks, so that fits can be repeated.
    """

    alone = False

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.rank, self.count = context.partitionId(), len(context.getTaskInfos())
        self._files, inner = fs.FileSystem.from_uri(folder)
        # A stage that is run again does not meet files of its last run.
        self._folder = f"{inner}/{context.allGather(uuid4().hex)[0]}"
        self._files.create_dir(self._folder, recursive=True)
        self._turn = 0

    def _write(self, arrays: Sequence[np.ndarray]) -> None:
        path = f"{self._folder}/{self._turn}-{self.rank}"
        with self._files.open_output_stream(f"{path}.part") as sink:
            for a in arrays:
                sink.write(np.ascontiguousarray(a))
        self._files.move(f"{path}.part", path)  # whole files only are seen

    def _read(self, rank: int, place: int = 0, size: int | None = None) -> bytes:
        path, delay = f"{self._folder}/{self._turn}-{rank}", 0.0005
        while self._files.get_file_info(path).type == fs.FileType.NotFound:
            sleep(delay)
            delay = min(2 * delay, 0.02)
        with self._files.open_input_file(path) as source:
            return source.read_at(source.size() if size is None else size, place)

    def _done(self) -> None:
        """All have written this turn's file, so all have read the one before."""
        if self._turn:
            self._files.delete_file(f"{self._folder}/{self._turn - 1}-{self.rank}")
        self._turn += 1

    def _told(self, *arrays: np.ndarray) -> list[list[np.ndarray]]:
        """The arrays, of one length and of eight bytes an entry, of every task."""
        self._write(arrays)
        out = []
        for rank in range(self.count):
            data = self._read(rank)
            size = len(data) // len(arrays)
            out.append([np.frombuffer(data[k * size : (k + 1) * size], a.dtype) for k, a in enumerate(arrays)])
        self._done()
        return out

    def add(self, *sums: np.ndarray) -> list[np.ndarray]:
        told = self._told(*sums)
        return [np.sum([task[k] for task in told], axis=0) for k in range(len(sums))]

    def classes(self, y: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([task[0] for task in self._told(np.unique(y))]))

    def own(self, count: int) -> tuple[int, int]:
        return self.rank * count // self.count, (self.rank + 1) * count // self.count

    def columns(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        """Sums of (slot, column, bin) over all tasks, for the own columns."""
        slots, columns, bins = sums[0].shape
        ends = [rank * columns // self.count for rank in range(self.count + 1)]
        self._write([total[:, first:last] for first, last in zip(ends, ends[1:]) for total in sums])
        first, last = self.own(columns)
        shape = (len(sums), slots, last - first, bins)
        out = np.zeros(shape)
        for rank in range(self.count):
            data = self._read(rank, len(sums) * slots * first * bins * 8, prod(shape) * 8)
            out += np.frombuffer(data).reshape(shape)
        self._done()
        return list(out)

    def best(self, gain: np.ndarray, feature: np.ndarray, at: np.ndarray):
        """The best split of every node among those of all tasks; ties go to the first columns, as in ``best_splits``."""
        told = self._told(gain, feature, at)
        gains = np.stack([task[0] for task in told])
        which = (gains >= gains.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
        return tuple(np.stack([task[k] for task in told])[which, np.arange(len(gain))] for k in range(3))


def best_splits(g: np.ndarray, h: np.ndarray):
    """Best (gain, feature, bin) of every node from its histograms; gain is 0 where no split is allowed.

    A split sends bins up to ``bin`` to the left. Ties (gains that differ in their last digits only) go to the first feature
    and its smallest bin.
    """
    nodes, features, bins = g.shape
    best, which, cut = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    if not features:
        return best, which, cut
    left_h = h.cumsum(axis=2)
    all_g, all_h = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    # The last bin leaves nothing on the right.
    allowed = (left_h >= LEAST_WEIGHT) & (all_h[:, None, None] - left_h >= LEAST_WEIGHT)
    allowed[:, :, -1] = False
    place = np.flatnonzero(allowed)
    if not len(place):
        return best, which, cut
    node = place // (features * bins)
    left_g, left_h = g.cumsum(axis=2).ravel()[place], left_h.ravel()[place]
    all_g, all_h = all_g[node], all_h[node]
    gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
    starts = np.flatnonzero(np.diff(node, prepend=-1))
    some = node[starts]
    top = np.maximum.reduceat(gain, starts)
    best[some] = top
    tied = np.flatnonzero(gain >= (best * (1 - np.sign(best) * 1e-9))[node])
    at = tied[np.searchsorted(node[tied], some)]
    best[some], which[some], cut[some] = gain[at], place[at] // bins % features, place[at] % bins
    return np.maximum(best, 0.0), which, cut


def grow(
    bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int | None, columns: Columns | None = None, peers: Alone | Peers = Alone()
):
    """One tree per column of the derivatives ``g`` and ``h``, grown together level by level.

    A node whose second derivatives cannot fill two children is not looked at. Of two children with many rows the smaller one
    is counted, the other one is what is left of their parent. With ``peers``, rows and values are those of this task, the trees
    those of all.
    Returns the nodes (class, node, feature or -1, bin, gain, cover, left, right, value) and the trees' values for every row.
    """
    columns = columns or Columns(bins)
    width = len(columns.features) * BINS
    begin, end = peers.own(len(columns.features))
    count, classes = g.shape
    g, h = (np.ascontiguousarray(d.T).ravel() for d in (g, h))
    values = np.zeros(count * classes)
    entry, slot = np.arange(count * classes), np.repeat(np.arange(classes), count)  # by slot
    owner, name, used = np.arange(classes), np.zeros(classes, np.int64), np.ones(classes, np.int64)
    nodes, level = [], 0
    of_parent, parents = np.full(0, -1), []  # for every pair of slots the place of its parent's sums, if they are kept
    while len(owner):
        slots = len(owner)
        weights, row = (g[entry], h[entry]), entry % max(count, 1)
        here = np.bincount(slot, minlength=slots)
        bounds = np.append(0, np.cumsum(here))
        # Without entries bincount gives integers.
        total_g, total_h, sizes = peers.add(*(np.bincount(slot, weight, slots).astype(np.float64) for weight in weights), here)
        gain, feature, at = np.zeros(slots), np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        kept, place = [], np.full(slots, -1)
        step = max(_CACHED // max(width, 1), 1)

        def counted(some: np.ndarray):
            there = np.arange(here[some].sum()) + np.repeat(bounds[some] - (np.cumsum(here[some]) - here[some]), here[some])
            own = np.repeat(np.arange(len(some)), here[some])
            return columns.histograms(row[there], own, [w[there] for w in weights], len(some))

        def added(some: np.ndarray):
            pieces = [counted(some[k : k + step]) for k in range(0, len(some), step)]
            return peers.columns(pieces[0] if len(pieces) == 1 else [np.concatenate(p) for p in zip(*pieces)])

        def look(some: np.ndarray, sums) -> None:
            pieces = [best_splits(*(total[k : k + step] for total in sums)) for k in range(0, len(some), step)]
            found, best, cut = (np.concatenate(p) for p in zip(*pieces))
            gain[some], best, at[some] = peers.best(found, best + begin, cut)
            feature[some] = columns.features[best]
            for k in np.flatnonzero((gain[some] > LEAST_GAIN) & (sizes[some] >= 2 * _FEW)):
                place[some[k]] = len(kept)
                kept.append([total[k].copy() for total in sums])

        if (depth is None or level < depth) and width:
            looked = total_h >= 2 * LEAST_WEIGHT * (1 - 1e-9)
            at_once = step if peers.alone else max(_EXCHANGED // width, 1)
            if not level and looked.any():
                look(np.arange(slots), peers.columns(columns.histograms(None, slot, weights, slots)))
            elif level:
                pairs = looked.reshape(-1, 2).any(axis=1)
                known = np.flatnonzero(pairs & (of_parent >= 0))
                for first in range(0, len(known), at_once):
                    some = known[first : first + at_once]
                    less = 2 * some + (sizes[2 * some + 1] < sizes[2 * some])
                    sums = added(less)
                    whole = (np.stack([parents[k][w] for k in of_parent[some]]) for w in (0, 1))
                    rest = [every - own for every, own in zip(whole, sums)]
                    look(np.concatenate([less, less ^ 1]), [np.concatenate(pair) for pair in zip(sums, rest)])
                others = np.flatnonzero(looked & np.repeat(of_parent < 0, 2))
                others = others[np.argsort(sizes[others], kind="stable")]
                for first in range(0, len(others), at_once):
                    some = others[first : first + at_once]
                    look(some, added(some))
        split = gain > LEAST_GAIN
        of_parent, parents = place[split], kept
        value = np.where(split, 0.0, -LEARNING_RATE * total_g / (total_h + L2))
        # Children of a tree's nodes get its next numbers, in order.
        before = np.cumsum(split) - split
        of_tree = before - before[np.searchsorted(owner, owner)]
        left = np.where(split, used[owner] + 2 * of_tree, -1)
        shown = np.where(split, feature, -1)
        nodes.append((owner, name, shown, at, np.where(split, gain, 0), total_h, left, np.where(split, left + 1, -1), value))
        used = used + 2 * np.bincount(owner, split, classes).astype(np.int64)
        go = split[slot]
        values[entry[~go]] = value[slot[~go]]
        entry, slot = entry[go], slot[go]
        right = bins[row[go], feature[slot]] > at[slot]
        slot = 2 * before[slot] + right
        owner = np.repeat(owner[split], 2)
        name = np.stack([left[split], left[split] + 1], axis=1).ravel()
        order = np.argsort(slot.astype(np.uint16) if len(owner) <= 1 << 16 else slot, kind="stable")
        entry, slot = entry[order], slot[order]
        level += 1
    return [np.concatenate(c) for c in zip(*nodes)], values.reshape(classes, count).T


def boosted(
    bins: np.ndarray, y: np.ndarray, weight: np.ndarray, edges, rounds: int, depth: int | None, peers: Alone | Peers = Alone()
) -> pa.Table:
    """The nodes of one model, without its name; with ``peers``, from the rows of all."""
    classes = peers.classes(y)
    margins, hot = np.zeros((len(y), len(classes))), y[:, None] == classes
    columns = Columns(bins) if peers.alone else Columns(bins, np.array([len(limits) + 1 for limits in edges]))
    found = []
    for number in range(rounds):
        share = softmax(margins)
        g = weight[:, None] * (share - hot)
        h = weight[:, None] * np.maximum(2 * share * (1 - share), 1e-16)
        nodes, values = grow(bins, g, h, depth, columns, peers)
        margins += values
        found.append((np.full(len(nodes[0]), number), *nodes))
    number, kind, node, feature, at, gain, cover, left, right, value = (np.concatenate(c) for c in zip(*found))
    threshold = np.zeros(len(feature))
    for k, limits in enumerate(edges):
        here = feature == k
        threshold[here] = limits[at[here]]
    columns = [number, classes[kind].astype(np.int64), node, feature, threshold, gain, cover, left, right, value]
    return pa.table([pa.array(c).cast(t) for c, t in zip(columns, _NODES.types[1:])], names=_NODES.names[1:])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(-1, width) if flat else np.zeros((0, width))


def packed_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of rows of ``width`` bytes each."""
    fixed = [c.cast(pa.binary(width)) for c in column.chunks if len(c)]
    rows = [np.frombuffer(c.buffers()[1], np.uint8, len(c) * width, c.offset * width) for c in fixed]
    return np.concatenate(rows).reshape(-1, width) if rows else np.zeros((0, width), np.uint8)


def binned_rows(named: DataFrame, edges: Sequence[np.ndarray]) -> DataFrame:
    """``bins`` in the place of ``features``: one byte per feature, so that less is moved to the fits."""
    kept = [c for c in named.columns if c != "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rows = binned(_matrix(part.column("features"), len(edges)), edges)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(edges)), len(rows), [None, pa.py_buffer(rows)])
            yield from part.select(kept).append_column("bins", packed.cast(pa.binary())).to_batches()

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.select(*kept).schema.fields)
    return named.mapInArrow(run, f"{types}, bins binary")


def _fit_apart(rows: DataFrame, names: Sequence[str], edges, rounds: int, depths: dict[str, int | None], key: Sequence[str]) -> DataFrame:
    """Nodes of large models: one barrier stage, whose tasks hold all rows among them and fit one model after the other."""
    spark = rows.sparkSession
    folder, width = new_table_path(spark, "sums"), len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Peers(folder)
        table = list(batches)
        if table:
            table = pa.Table.from_batches(table).sort_by([(c, "ascending") for c in key])
            bins = packed_rows(table.column("bins"), width)
            y, weight = (table.column(c).to_numpy() for c in ("y", "weight"))
            models = table.column("models").combine_chunks()
            member = np.repeat(np.arange(len(models)), models.value_lengths().to_numpy())
            model = models.flatten().to_numpy(zero_copy_only=False)
        else:
            bins, y, weight = np.zeros((0, width), np.uint8), np.zeros(0), np.zeros(0)
            member, model = np.zeros(0, np.int64), np.zeros(0, object)
        del table
        for name in names:
            own = member[model == name]
            nodes = boosted(bins[own], y[own], weight[own], edges, rounds, depths[name], peers)
            if not peers.rank:
                yield from nodes.add_column(0, "model", pa.array([name] * len(nodes), pa.string())).to_batches(1 << 16)

    dealt = rows.repartition(spark.sparkContext.defaultParallelism, *key)
    return dealt.mapInArrow(run, NODES, barrier=True)


def fit(
    rows: DataFrame, models: Column, rounds: int, depths: dict[str, int | None], key: Sequence[str] = ("ip",)
) -> DataFrame:
    """The node table of all models, stored.

    ``rows`` has features (a vector), y and weight; ``models`` is an array of the models a row trains; ``depths`` lists the
    models with their depth (None: no limit). Rows are taken in the order of ``key``, so that fits can be repeated. A
    model without rows has no nodes. Models of more than ``GROUP_ROWS`` rows are fitted by all tasks together, which barrier
    stages allow where executors are not added and removed on the way.
    """
    spark = rows.sparkSession
    ship_package(spark)
    edges = bin_edges(rows)
    width = len(edges)
    plain = rows.select(*key, "y", "weight", vector_to_array("features").alias("features"), models.alias("models"))
    named = plain.withColumn("model", F.explode("models"))
    counts = {r["model"]: r["count"] for r in named.groupBy("model").count().collect()}
    for model, n in counts.items():
        if MAX_ROWS and n > MAX_ROWS:
            kept = F.pmod(F.xxhash64(*key), F.lit(_HASHED)) < int(MAX_ROWS / n * _HASHED)
            without = F.array_remove("models", model)
            plain = plain.withColumn("models", F.when(kept, F.col("models")).otherwise(without))
    fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
    large = sorted(m for m, n in counts.items() if fixed and min(n, MAX_ROWS or n) > GROUP_ROWS)
    small = [m for m in counts if m not in large]
    moved = binned_rows(plain, edges) if counts else plain.withColumn("bins", F.lit(b""))

    def run(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        table = table.sort_by([(c, "ascending") for c in key])
        y, weight = (table.column(c).to_numpy() for c in ("y", "weight"))
        nodes = boosted(packed_rows(table.column("bins"), width), y, weight, edges, rounds, depths[model])
        return nodes.add_column(0, "model", pa.array([model] * len(nodes), pa.string()))

    parts = []
    if small or not large:
        # Many more tasks than models, so that few of them share one; a given number is not coalesced.
        each = moved.withColumn("model", F.explode("models")).select("model", *key, "y", "weight", "bins")
        dealt = each.filter(F.col("model").isin(small)).repartition(max(4 * len(counts), 96), "model")
        parts.append(stored(dealt.groupBy("model").applyInArrow(run, NODES), "boosted-nodes"))
    if large:
        wanted = F.filter("models", lambda m: m.isin(large)).alias("models")
        of_large = moved.select(*key, "y", "weight", "bins", wanted).filter(F.size("models") > 0)
        parts.append(stored(_fit_apart(of_large, large, edges, rounds, depths, key), "boosted-nodes"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Forest:
    """The nodes of one model in arrays, all trees one after the other."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by([(c, "ascending") for c in ("round", "class", "node")])
        number, kind, node, feature, left = (nodes.column(c).to_numpy() for c in ("round", "class", "node", "feature", "left"))
        self.classes, of = np.unique(kind, return_inverse=True)
        self.roots = np.flatnonzero(node == 0)
        self.kind = of[self.roots]
        base = np.repeat(self.roots, np.diff(np.append(self.roots, len(node))))
        self.feature, self.left = feature, np.where(feature >= 0, base + left, np.arange(len(node)))
        self.threshold, self.value = (nodes.column(c).to_numpy() for c in ("threshold", "value"))

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Sum of the trees' values per class for every row; a right child follows its left one."""
        out = np.zeros((len(values), len(self.classes)))
        step = max(_ENTRIES // max(len(self.roots), 1), 1)
        for start in range(0, len(values), step):
            part = values[start : start + step]
            at = np.tile(self.roots, len(part))
            inner = np.flatnonzero(self.feature[at] >= 0)
            while len(inner):
                node = at[inner]
                x = part[inner // len(self.roots), self.feature[node]]
                at[inner] = node = self.left[node] + ~(x <= self.threshold[node])
                inner = inner[self.feature[node] >= 0]
            at = at.reshape(len(part), -1)
            for k in range(len(self.classes)):
                out[start : start + step, k] = self.value[at[:, self.kind == k]].sum(axis=1)
        return out


def predict(rows: DataFrame, nodes: DataFrame, models: Column, keep: Sequence[str], name: str = "y_pred") -> DataFrame:
    """model, the columns ``keep``, and the class that each model of the array ``models`` gives the row."""
    blocks = -(-rows.count() // SCORED_ROWS) or 1
    block = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).alias("block")
    dealt = rows.select(*keep, vector_to_array("features").alias("features"), models.alias("models"), block)
    dealt = dealt.withColumn("model", F.explode("models")).drop("models")
    spread = nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    kept = dealt.select("model", *keep).schema
    names = kept.names

    def run(trees: pa.Table, part: pa.Table) -> pa.Table:
        out = part.select(names)
        if not part.num_rows or not trees.num_rows:
            return out.append_column(name, pa.array([None] * part.num_rows, pa.int64()))
        width = len(part.column("features")[0])
        forest = Forest(trees)
        best = forest.margins(_matrix(part.column("features"), width)).argmax(axis=1)
        return out.append_column(name, pa.array(forest.classes[best], pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields)
    left, right = spread.groupBy("model", "block"), dealt.groupBy("model", "block")
    return left.cogroup(right).applyInArrow(run, f"{schema}, `{name}` bigint")


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """model, feature, importance: the mean gain of a feature's splits, as a share of the sum over features (0 without any)."""
    gains = nodes.filter("feature >= 0").groupBy("model", "feature").agg(F.avg("gain").alias("gain"))
    total = gains.groupBy("model").agg(F.sum("gain").alias("total"))
    names = F.posexplode(F.array(*map(F.lit, features))).alias("number", "name")
    every = nodes.select("model").distinct().select("model", names)
    found = every.join(gains.join(total, "model").withColumnRenamed("feature", "number"), ["model", "number"], "left")
    share = F.coalesce(F.col("gain") / F.col("total"), F.lit(0.0))
    return found.select("model", F.col("name").alias("feature"), share.alias("importance"))


def write_models(nodes: DataFrame, path: str) -> None:
    """One folder per model."""
    nodes.write.partitionBy("model").parquet(path)


def read_models(spark, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path).select("model", *_NODES.names[1:])
