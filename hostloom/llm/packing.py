"""Best-fit packing of token sequences by a grouping genetic algorithm.

Pieces of full length are sequences of their own. The others are dealt into blocks of bounded size by a hash of
their number. A block is bred on several islands: a population of packings, in which a child takes whole well-filled
bins from one parent, loses the bins of the other parent that hold the same pieces, and best-fits the
displaced pieces. Between epochs every island sends its elite to the next one, by a grouping on (block, island).
The poorly filled bins of all blocks are pooled and bred again in fewer blocks, until one is left.

What travels are piece lengths and bin numbers; token ids move once, in the join with the final places.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.text import chunks
from hostloom.llm.tokens import encoder
from hostloom.session import stored

CAPACITY = 1024
BLOCK_PIECES = 4096
ISLANDS = 3
POPULATION = 4
EPOCHS = 2
CHILDREN = 4
# Islands are bred this many to a task, in no more than so many tasks: breeding costs time, not bytes, so their
# number cannot be left to a limit on bytes.
ISLANDS_PER_TASK = 8
MAX_TASKS = 20_000
WELL_FILLED = 0.99
# Bins less full are pooled for the next round. Lengths that seldom fill a bin would leave most pieces in the pool;
# then the next lower limit is taken, so that the emptiest bins are pooled at least.
POOLED_BELOW = (WELL_FILLED, 0.9, 0.75, 0.5)

_PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids binary"
_STATE = "block bigint, island int, lengths array<int>, population array<array<int>>"
_PLACES = "block bigint, item bigint, bin bigint, offset bigint, filled bigint"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id`` and cut what exceeds ``capacity``.

    All pieces of a document are ``capacity`` long but the first, which takes the remainder. ids are little-endian
    32-bit numbers; uid is unique, so repeated rows stay apart. The result is stored, which fixes the uids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        uid = TaskContext.get().partitionId() << 33
        for batch, data, offsets in chunks(batches):
            ids, bounds = encode.encode(data, offsets, end_id)
            lengths = np.diff(bounds)
            count = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = lengths - (count - 1) * capacity
            size = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            ends = np.append(0, np.cumsum(size)).astype(np.int32) * 4
            body = pa.Array.from_buffers(
                pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4").tobytes())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(len(doc))),
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(size),
                    body,
                ],
                names=["uid", "doc_id", "piece", "start", "length", "ids"],
            )
            uid += len(doc)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, _PIECES)
    return stored(rows, "pieces")


# --- one block: plain functions over lists of piece numbers


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> None:
    """Put every item, in the given order, into the fullest bin that has room for it, or a new one."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: there is a bin with room r
    for b, held in enumerate(bins):
        room = capacity - sum([lengths[i] for i in held])
        if room:
            by_room[room].append(b)
            free |= 1 << room
    for item in items:
        length = lengths[item]
        fitting = free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                free ^= 1 << room
            bins[b].append(item)
        else:
            b, room = len(bins), capacity
            bins.append([item])
        if room > length:
            by_room[room - length].append(b)
            free |= 1 << (room - length)


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared filling: of two packings into equally many bins, the one with fuller bins is better."""
    return sum((sum([lengths[i] for i in held]) / capacity) ** 2 for held in bins) / max(len(bins), 1)


def cross(mother, father, lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child of two packings, and a mutation: a few of its bins are dissolved too."""
    full = [held for held in father if sum([lengths[i] for i in held]) >= WELL_FILLED * capacity]
    injected = rng.sample(full, (len(full) + 1) // 2) if full else []
    taken = {i for held in injected for i in held}
    child, displaced = [list(held) for held in injected], []
    for held in mother:
        clash = not taken.isdisjoint(held)
        poor = sum([lengths[i] for i in held]) < WELL_FILLED * capacity and rng.random() < 0.5
        if clash or poor or rng.random() < 0.02:
            displaced += [i for i in held if i not in taken]
        else:
            child.append(list(held))
    # Items are numbered from the longest to the shortest.
    displaced.sort()
    best_fit(child, displaced, lengths, capacity)
    return child


def as_bins(assignment) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(assignment) + 1)]
    for item, b in enumerate(assignment):
        bins[b].append(item)
    return bins


def as_assignment(bins: list[list[int]], count: int) -> list[int]:
    out = [0] * count
    for b, held in enumerate(bins):
        for item in held:
            out[item] = b
    return out


def evolve(lengths: list[int], population: list, capacity: int, seed: int) -> list[list[int]]:
    """One epoch of one island; the best packing comes first. An empty population is founded here."""
    rng = random.Random(seed)
    count = len(lengths)
    crowd = [as_bins(a) for a in population]
    for k in range(len(crowd), POPULATION):
        noise = 0 if k == 0 and not population else capacity // 16
        order = sorted(range(count), key=lambda i: -lengths[i] - rng.random() * noise)
        bins: list[list[int]] = []
        best_fit(bins, order, lengths, capacity)
        crowd.append(bins)
    rated = [(fitness(b, lengths, capacity), b) for b in crowd]
    rated.sort(key=lambda x: -x[0])
    least = -(-sum(lengths) // capacity)
    for _ in range(CHILDREN):
        if len(rated[0][1]) <= least:  # no packing has fewer bins
            break
        mother, father = rng.sample(rated, 2) if rng.random() < 0.5 else rated[:2][:: rng.choice((1, -1))]
        child = cross(mother[1], father[1], lengths, capacity, rng)
        rated.append((fitness(child, lengths, capacity), child))
        rated.sort(key=lambda x: -x[0])
        rated.pop()
    return [as_assignment(b, count) for _, b in rated[:POPULATION]]


# --- the islands


def _gathered():
    """All packings of a group, sorted: a repeated task breeds the same ones whatever order they arrive in."""
    return F.sort_array(F.flatten(F.collect_list("population")))


def _epoch(states: DataFrame, epoch: int, capacity: int, tasks: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, island, lengths, population in frame.itertuples(index=False):
                bred = evolve(lengths.tolist(), list(population), capacity, hash((block, island, epoch)))
                sent = [(block, island, lengths, bred), (block, (island + 1) % ISLANDS, lengths, bred[:1])]
                yield pd.DataFrame(sent, columns=frame.columns)

    letters = states.mapInPandas(run, _STATE)  # own population, and the elite addressed to the next island
    return letters.repartition(tasks, "block", "island").groupBy("block", "island").agg(
        F.first("lengths").alias("lengths"), _gathered().alias("population")
    )


def _place(states: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """The best packing of a block as (block, item, bin, offset, filled)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, lengths, packings in frame.itertuples(index=False):
                lengths = lengths.tolist()
                best = max((as_bins(a) for a in packings), key=lambda b: (-len(b), fitness(b, lengths, capacity)))
                rows = []
                for number, held in enumerate(best):
                    place, filled = 0, sum([lengths[i] for i in held])
                    for item in held:
                        rows.append((block, item, number, place, filled))
                        place += lengths[item]
                yield pd.DataFrame(rows, columns=["block", "item", "bin", "offset", "filled"])

    gathered = states.repartition(tasks, "block").groupBy("block").agg(
        F.first("lengths").alias("lengths"), _gathered().alias("packings")
    )
    return gathered.mapInPandas(run, _PLACES)


def _packed_blocks(items: DataFrame, count: int, level: int, capacity: int) -> DataFrame:
    blocks = max(-(-count // BLOCK_PIECES), 1)
    block = F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks))
    longest_first = Window.partitionBy("block").orderBy(F.desc("length"), "uid")
    numbered = items.withColumn("block", block).withColumn("item", F.row_number().over(longest_first).cast("bigint") - 1)
    numbered = stored(numbered, f"pack-items-{level}")
    lengths = F.transform(F.sort_array(F.collect_list(F.struct("item", "length"))), lambda x: x["length"].cast("int"))
    founded = (
        numbered.groupBy("block")
        .agg(lengths.alias("lengths"))
        .select(
            "block",
            F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"),
            "lengths",
            F.array().cast("array<array<int>>").alias("population"),
        )
    )
    tasks = min(-(-blocks * ISLANDS // ISLANDS_PER_TASK), MAX_TASKS)
    states = founded.repartition(tasks, "block", "island")
    for epoch in range(EPOCHS):
        states = _epoch(states, epoch, capacity, tasks)
    return stored(numbered.join(_place(states, capacity, tasks), ["block", "item"]), f"pack-places-{level}")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places for (uid, length) with lengths up to ``capacity``: uid, sequence_id, offset.

    uid is unique. Sequence ids are even numbers, as ``packed`` gives odd ones to full pieces.
    """
    level, count = 0, items.count()
    done = []
    while True:
        placed = _packed_blocks(items, count, level, capacity)
        number = (F.lit(level).cast("bigint") * (1 << 55) + F.col("block") * (1 << 20) + F.col("bin")) * 2
        places = placed.withColumn("sequence_id", number)
        if count <= BLOCK_PIECES:
            done.append(places)
            break
        # Pieces below each limit; the first limit that at least halves their number decides.
        poor = placed.agg(*[F.count_if(F.col("filled") < share * capacity) for share in POOLED_BELOW]).first()
        pooled = [(share, left) for share, left in zip(POOLED_BELOW, poor) if left <= count // 2]
        if not pooled or not pooled[0][1]:  # nothing to pool
            done.append(places)
            break
        share, left = pooled[0]
        keep = F.col("filled") >= share * capacity
        items = placed.filter(~keep).select("uid", "length")
        done.append(places.filter(keep))
        level, count = level + 1, left
    columns = ["uid", "sequence_id", "offset"]
    out = done[0].select(columns)
    for more in done[1:]:
        out = out.unionByName(more.select(columns))
    return out


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored pieces with sequence_id and offset. An empty table gives no row."""
    short = F.col("length") < capacity
    places = pack(cut.filter(short).select("uid", "length"), capacity)
    alone = cut.filter(~short).withColumns({"sequence_id": F.col("uid") * 2 + 1, "offset": F.lit(0).cast("bigint")})
    # Places grow with the pieces, so they are never broadcast.
    return cut.filter(short).join(places.hint("shuffle_merge"), "uid").unionByName(alone)


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
