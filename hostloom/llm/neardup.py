"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives every document its number of shingles, a 128-bit key of its words and its band
   keys. Documents with equal words form a class; only its first document goes on.
2. Documents that share a band are candidates. They are linked in three rounds, so that a group of thousands
   never spells out its pairs: twice every document with the leader (smallest document of a bucket) it shares most
   buckets with, among those not yet in its component; then the documents of all buckets that still hold
   several components. Among these, pairs of different components meet where they share a rare shingle and
   their sizes and the shingle's places allow the threshold; that loses no pair.
3. A candidate pair's signatures are compared batch by batch. The pair is dropped once the posterior
   probability of reaching the threshold, given the matches so far, is below the miss probability. In the last round
   this begins in the meeting, on one byte of each of the first values, before a pair becomes a row, and a pair that
   meets often is taken where samples of both ends say. Survivors are verified on their full sets.

A pair at the threshold shares no band with probability (1 - 0.75**4)**40 < 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.components import components
from hostloom.llm.text import ASCII_LOWER, chunks, gram_hashes, mixed, runs, span_hashes, words
from hostloom.session import stored

SHINGLE = 5
PERCENT = 75
HASHES = 160
BAND_ROWS = 4
BATCH = 16
MISS_PROBABILITY = 1e-6
SKETCH = 1 << 16
_SKETCH_SHIFT = np.uint64(48)
# What travels with a rare shingle: a byte of each of the first signature values, and the smallest of the rare shingles.
BYTES, SAMPLE = 48, 8
_MEETING_ROWS, _MEETING_PAIRS = 1 << 14, 1 << 17

_draw = np.random.default_rng(75)
_FACTORS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BANDS = mixed(np.arange(1, HASHES // BAND_ROWS + 1, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """Words' hashes, first word of each text, and all texts' sorted distinct shingle hashes with their bounds."""
    lower = ASCII_LOWER[data]
    starts, ends, first = words(lower, offsets)
    hashes = span_hashes(lower, starts, ends)
    count = np.diff(first)
    # Shingles start at every word that has enough words after it; a shorter text is one shingle.
    numbers = np.maximum(count - SHINGLE + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), numbers)
    place = np.repeat(first[:-1], numbers) + runs(numbers)
    codes = np.zeros(len(place), np.uint64)
    length = np.minimum(count, SHINGLE)[owner]
    for size in range(1, SHINGLE + 1):
        here = length == size
        if here.any():
            codes[here] = gram_hashes(hashes, size)[place[here]]
    order = np.lexsort((codes, owner))
    codes = codes[order]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return hashes, first, codes[keep], np.searchsorted(owner[keep], np.arange(len(count) + 1))


def signatures(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash signature of every set; sets without elements get all ones."""
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        high = (codes >> np.uint64(32)).astype(np.uint32)
        starts = bounds[:-1][filled]
        for k in range(HASHES):
            out[filled, k] = np.minimum.reduceat(high * _FACTORS[k] + _SHIFTS[k], starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, BAND_ROWS // 2)
    key = rows[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, rows.shape[2]):
        key = mixed(key) ^ rows[:, :, k]
    return mixed(key ^ _BANDS)


def _sequence_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every text's sequence of words."""
    count = np.diff(first)
    filled = np.flatnonzero(count)
    keys = (np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64))
    if len(filled):
        place = runs(count[filled]).astype(np.uint64)
        for key, salt in zip(keys, (1, 2)):
            mark = mixed(place * np.uint64(0xD1B54A32D192ED03) + np.uint64(salt))
            key[filled] = mixed(np.add.reduceat(mixed(hashes ^ mark), first[:-1][filled]) + count[filled].astype(np.uint64))
    return keys


_FEATURES = "doc_id bigint, n_shingles bigint, key_a bigint, key_b bigint, bands array<bigint>"


def features(docs: DataFrame) -> DataFrame:
    """One row per document, stored: number of shingles, key of its words, band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            hashes, first, codes, bounds = shingle_sets(data, offsets)
            key_a, key_b = _sequence_keys(hashes, first)
            sizes = np.diff(bounds)
            bands = band_keys(signatures(codes, bounds))[sizes > 0]
            ends = np.append(0, np.cumsum(np.where(sizes > 0, HASHES // BAND_ROWS, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array(key_a.view(np.int64)),
                    pa.array(key_b.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "key_a", "key_b", "bands"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, _FEATURES), "neardup-features")


def _with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, signature, members (sorted shingle hashes) of the wanted documents, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            _, _, codes, bounds = shingle_sets(data, offsets)
            signature = signatures(codes, bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([row.tobytes() for row in signature], pa.binary()),
                    pa.array([codes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                ],
                names=["doc_id", "signature", "members"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return stored(rows.mapInArrow(run, "doc_id bigint, signature binary, members binary"), "neardup-sets")


def least_matches(percent: int = PERCENT, miss: float = MISS_PROBABILITY) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after every batch.

    With a uniform prior the posterior after m matches in n is Beta(m + 1, n - m + 1), and the probability that the
    similarity reaches t equals that of at most m successes in n + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _survivors(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that sequential comparison of their signatures does not rule out."""
    needed = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES)
                for c in ("signature_a", "signature_b")
            )
            alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for n, least in needed:
                matches[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def side(c: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(c), F.col("signature").alias(f"signature_{c}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "signature_a", "signature_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("members_a").to_pylist(), batch.column("members_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(c: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(c), F.col("members").alias(f"members_{c}"))

    survivors = stored(_survivors(pairs, sets), "neardup-survivors")
    both = survivors.join(side("a"), "a").join(side("b"), "b").select("a", "b", "members_a", "members_b")
    return stored(both.mapInArrow(run, "a bigint, b bigint"), "neardup-links")


def _labelled(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with the component of their document, stored."""
    labels = components(links).withColumnRenamed("node", "doc_id")
    joined = buckets.join(labels, "doc_id", "left")
    labelled = joined.select("key", "doc_id", "leader", F.coalesce("component", "doc_id").alias("component"))
    # Only buckets that hold several components have pairs left to look at.
    mixed_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
    return stored(labelled.join(mixed_keys.select("key"), "key", "left_semi"), "neardup-mixed")


def _best_leaders(buckets: DataFrame) -> DataFrame:
    """Per document the leader it shares most buckets with (ties: the smallest), as (a, b)."""
    shared = buckets.filter("doc_id <> leader").groupBy("doc_id", "leader").count()
    best = F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader")
    pairs = shared.groupBy("doc_id").agg(best)
    return pairs.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur, in a table of fixed size by the top bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("members").to_pylist()), np.uint64)
            total += np.bincount((codes >> _SKETCH_SHIFT).astype(np.int64), minlength=SKETCH)
        place = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total[place])], names=["place", "n"])

    counted = sets.select("members").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(SKETCH, np.int64)
    for row in counted.collect():  # at most SKETCH rows
        out[row["place"]] = row["n"]
    return out


def _prefix_rows(members: DataFrame, frequency: np.ndarray) -> DataFrame:
    """token, doc_id, component, n (size), rest, sketch, sample, places (of the sample) for the rare end of every set.

    Sets are put in one order, rare shingles first. Two sets that reach the threshold share a shingle among the first
    n - ceil(t n) + 1 of either; ``rest`` counts those from it on, which bounds what they can share.
    """
    shared = members.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts, sizes = [], []
            for body in batch.column("members").to_pylist():
                codes = np.frombuffer(body, np.uint64)
                order = np.argsort(shared.value[(codes >> _SKETCH_SHIFT).astype(np.int64)], kind="stable")
                firsts.append(codes[order[: len(codes) + (-PERCENT * len(codes) // 100) + 1]])
                sizes.append(len(codes))
            counts = np.array([len(f) for f in firsts])
            row, n = np.repeat(np.arange(len(counts)), counts), np.repeat(np.array(sizes), counts)
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
            sketch = pa.array([s.tobytes() for s in signature[:, :BYTES].astype(np.uint8)], pa.binary())
            least = [np.argsort(f)[:SAMPLE] for f in firsts]
            sample = [f[at].tobytes().ljust(8 * SAMPLE, b"\0") for f, at in zip(firsts, least)]
            places = [at.astype(np.uint32).tobytes().ljust(4 * SAMPLE, b"\0") for at in least]
            same = (sketch, pa.array(sample, pa.binary()), pa.array(places, pa.binary()))
            same = (batch.column("doc_id"), batch.column("component"), *same)
            doc, component, *carried = (c.take(pa.array(row)) for c in same)
            token, rest = pa.array(np.concatenate(firsts).view(np.int64)), pa.array(n - runs(counts))
            columns = [token, doc, component, pa.array(n), rest, *carried]
            names = ["token", "doc_id", "component", "n", "rest", "sketch", "sample", "places"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "token bigint, doc_id bigint, component bigint, n bigint, rest bigint"
    return members.mapInArrow(run, f"{schema}, sketch binary, sample binary, places binary")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """The sorted rows again, about ``size`` at a time, no group of equal keys cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        end = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if end:
            yield table.slice(0, end).combine_chunks()
            held, rows = table.slice(end).to_batches(), rows - end
        size = max(size, 2 * rows) if not end else max(_MEETING_ROWS, rows + 1)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _fixed(column: pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _meetings(rows: pa.Table) -> Iterator[np.ndarray]:
    """Pairs (a, b) that may reach the threshold, of rows sorted by (token, band).

    A pair meets at every common shingle of its rare ends. Where the samples of both have common shingles whose places allow
    the threshold, the smallest of these is where the pair is taken; elsewhere any meeting that allows it takes it.
    """
    token, band, component = (rows.column(c).to_numpy() for c in ("token", "band", "component"))
    new = np.append(True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]))
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    several = np.minimum.reduceat(component, begin) < np.maximum.reduceat(component, begin)
    rows = rows.filter(pa.array(several[group]))
    group, component = group[several[group]], component[several[group]]
    if not len(group):
        return
    # The largest component of a meeting comes first and looks for no one; all others look at those before them.
    order = np.lexsort((component, group))
    g, c = group[order], component[order]
    part = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])))
    size = np.diff(np.append(part, len(g)))
    rank = np.lexsort((-size, g[part]))
    largest = np.zeros(len(part), bool)
    largest[rank[np.append(True, np.diff(g[part][rank]) != 0)]] = True
    first = np.empty(len(g), bool)
    first[order] = np.repeat(largest, size)
    order = np.lexsort((~first, group))
    rows, group, component, first = rows.take(pa.array(order)), group[order], component[order], first[order]
    doc, n, rest = (rows.column(k).to_numpy() for k in ("doc_id", "n", "rest"))
    guest = rows.column("guest").to_numpy(zero_copy_only=False).astype(bool)
    sketch, sample = _fixed(rows.column("sketch"), np.uint8, BYTES), _fixed(rows.column("sample"), np.uint64, SAMPLE)
    places = _fixed(rows.column("places"), np.uint32, SAMPLE).astype(np.int64)
    own, none = rows.column("token").to_numpy().view(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)
    begin = np.searchsorted(group, group)
    before = np.where(first, 0, np.arange(len(group)) - begin)
    total = np.cumsum(before)
    start = 0
    while start < len(before):
        end = max(int(np.searchsorted(total, total[start] - before[start] + _MEETING_PAIRS, side="right")), start + 1)
        x = np.repeat(np.arange(start, end), before[start:end])
        y = begin[x] + runs(before[start:end])
        start = end
        good = (component[x] != component[y]) & ~(guest[x] & guest[y])
        good &= (100 * n[x] >= PERCENT * n[y]) & (100 * n[y] >= PERCENT * n[x])
        # shared >= t / (1 + t) (|x| + |y|), and both share at most what lies from here on in either
        good &= (100 + PERCENT) * np.minimum(rest[x], rest[y]) >= PERCENT * (n[x] + n[y])
        x, y = x[good], y[good]
        matches = np.zeros(len(x), np.int64)
        for upto, least in least_matches()[: BYTES // BATCH]:  # equal values have equal bytes
            part = slice(upto - BATCH, upto)
            matches += (sketch[x, part] == sketch[y, part]).sum(axis=1)
            good = matches >= least
            x, y, matches = x[good], y[good], matches[good]
        common = (sample[x][:, :, None] == sample[y][:, None, :]) & (sample[x] > 0)[:, :, None]
        after = np.minimum((n[x, None] - places[x])[:, :, None], (n[y, None] - places[y])[:, None, :])
        common &= (100 + PERCENT) * after >= (PERCENT * (n[x] + n[y]))[:, None, None]
        taken = np.where(common.any(axis=2), sample[x], none).min(axis=1)
        good = (taken == none) | (taken == own[x])
        x, y = x[good], y[good]
        yield np.unique(np.stack([np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])], axis=1), axis=0)


def _crossing(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that a common rare shingle, sizes and rests allow to reach the threshold.

    Rows meet by shingle and size class; partners' sizes lie in the same class or the next, so each row is
    also a guest in the class above. Within a meeting only pairs that pass come into being.
    """
    # A class is a little wider than the largest quotient of sizes, so that rounding does no harm.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(101 / PERCENT)))
    visits = [
        F.struct((band + up).alias("band"), F.lit(up == 1).alias("guest"))
        for up in (0, 1)
    ]
    met = rows.withColumn("visit", F.explode(F.array(*visits)))
    met = met.select("token", "visit.band", "visit.guest", "n", "doc_id", "component", "rest", "sketch", "sample", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["token", "band"], _MEETING_ROWS):
            pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *_meetings(rows)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = met.repartition("token", "band").sortWithinPartitions("token", "band")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Verified links (a, b) between first documents of classes that connect all linked documents."""
    heads = found.filter("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id"))
    banded = found.join(heads, ["key_a", "key_b", "doc_id"], "left_semi")
    rows = banded.select("doc_id", F.explode("bands").alias("key"))
    leaders = rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"))
    buckets = stored(rows.join(leaders.filter("leader < last").drop("last"), "key"), "neardup-buckets")
    sets = _with_sets(docs, buckets.select("doc_id").distinct())

    known = verified(_best_leaders(buckets), sets)
    left = _labelled(buckets, known)
    of_leader = left.filter("doc_id = leader").select("key", F.col("component").alias("leader_component")).distinct()
    apart = left.join(of_leader, "key").filter("component <> leader_component")
    known = stored(known.unionByName(verified(_best_leaders(apart), sets)), "neardup-links")

    left = _labelled(left.drop("component"), known).select("doc_id", "component").distinct()
    apart = sets.join(left, "doc_id").select("doc_id", "component", "signature", "members")
    rare = _prefix_rows(apart, _frequencies(sets))
    return known.unionByName(verified(_crossing(rare), sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is that one).

    ``docs`` has doc_id and text. A text without words, or null, has no shingles and is linked with nothing. A row
    without doc_id is linked with nothing either, gets a null component and is kept. Rows that share a
    doc_id count as one document. An empty table gives no row.
    """
    found = features(docs)
    classes = found.filter("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b")
    classes = classes.agg(F.min("doc_id").alias("head"))
    labels = components(links(docs, found)).withColumnRenamed("node", "head")
    classes = classes.join(labels, "head", "left").select(
        "key_a", "key_b", F.coalesce("component", "head").alias("component")
    )
    rows = found.select("doc_id", "n_shingles", "key_a", "key_b").join(classes, ["key_a", "key_b"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
