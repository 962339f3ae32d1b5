"""Benchmark decontamination by the q-gram lemma.

A stretch of w characters with at most e edits shares at least w + 1 - q (e + 1) q-grams with its source, all on
diagonals (text position minus item position) that differ by at most e. So q-gram hits are counted in overlapping bands
of diagonals; regions in which w characters hold that many hits are kept, and verified by banded alignment.

Texts and items are compared by code points, with A-Z and the capitals of Latin-1 in lower case and all ASCII white
space as a space. An item shorter than a q-gram has none; it counts where it is a document's whole text.
The benchmark is read in blocks of bounded size; a block's index is broadcast and all documents are scanned
against it, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.text import ASCII_LOWER, SEPARATOR, chunks, mixed, runs
from hostloom.llm.winnowing import code_points

GRAM = 10
REGION = 80
EDIT_RATE = 1 / 16  # five edits in a region of 80
BAND = 8
INDEX_BYTES = 2 << 20

_NORMAL = np.where(SEPARATOR, 0x20, ASCII_LOWER).astype(np.uint32)
_NORMAL[0xC0:0xDF] += 0x20
_NORMAL[0xD7] = 0xD7
_FILTER_BITS = 22
_SCAN_BYTES = 1 << 20


def decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offset of each text in them."""
    lead = (data & 0xC0) != 0x80
    starts = np.flatnonzero(lead)
    if len(starts) == len(data):
        return data.astype(np.uint32), offsets
    first = data[starts].astype(np.uint32)
    more = (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    points = np.where(more > 0, first & (np.uint32(0x3F) >> more.astype(np.uint32)), first)
    for k in (1, 2, 3):
        longer = np.flatnonzero(more >= k)
        points[longer] = (points[longer] << np.uint32(6)) | (data[starts[longer] + k] & np.uint8(0x3F))
    return points, np.concatenate(([0], np.cumsum(lead)))[offsets]


def normal(points: np.ndarray) -> np.ndarray:
    """The code points as they are compared; none is added or taken away."""
    return np.where(points < 256, _NORMAL[np.minimum(points, 255)], points)


def gram_codes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of ``gram`` code points."""
    base = np.array([0x9E3779B97F4A7C15], np.uint64)
    total, size = None, 0
    power, length, factor, step = data.astype(np.uint64) + np.uint64(1), 1, base, gram
    count = len(data) - gram + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    while step:
        if step & 1:
            total = power[:count] if total is None else total * factor + power[size : size + count]
            size += length
        step >>= 1
        if step:
            power = power[:-length] * factor + power[length:]
            length, factor = length * 2, factor * factor
    return mixed(total)


class Index:
    """q-grams of some benchmark items, with each item's region length, edit budget and least number of hits."""

    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM, region: int = REGION, rate: float = EDIT_RATE):
        self.gram = gram
        texts = [normal(code_points(text)) for _, text in items]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.whole: dict[bytes, list[int]] = {}  # short items, by their text
        for number, text in enumerate(texts):
            if 0 < len(text) < gram:
                self.whole.setdefault(text.tobytes(), []).append(number)
        self.texts = texts
        lengths = np.array([len(t) for t in texts], np.int64)
        self.region = np.minimum(lengths, region)
        self.edits = np.minimum((self.region * rate).astype(np.int64), np.maximum(self.region // gram - 1, 0))
        self.least = self.region + 1 - gram * (self.edits + 1)
        # Items lie one after the other, far enough apart that no band touches two of them.
        gap = 4 * (BAND + int(self.edits.max(initial=0)))
        self.base = np.cumsum(lengths + gap) - (lengths + gap)
        codes = [gram_codes(t, gram) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        item = np.repeat(np.arange(len(texts)), sizes)
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.bounds = np.append(first, len(code))
        self.item = item[order]
        self.place = (self.base[item] + runs(sizes))[order] if len(code) else np.zeros(0, np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True


def _hits(data: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Text position and posting of every q-gram that text and items share, in order of position."""
    codes = gram_codes(data, index.gram)
    near = np.flatnonzero(index.filter[(codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(near) or not len(index.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.minimum(np.searchsorted(index.codes, codes[near]), len(index.codes) - 1)
    found = index.codes[row] == codes[near]
    near, row = near[found], row[found]
    count = index.bounds[row + 1] - index.bounds[row]
    return np.repeat(near, count), np.repeat(index.bounds[row], count) + runs(count)


def regions(data: np.ndarray, offsets: np.ndarray, index: Index):
    """(text, item, low, high, diagonal): regions with enough hits, low to high in ``data``, by band."""
    position, posting = _hits(data, index)
    text = np.searchsorted(offsets, position, side="right") - 1
    inside = position + index.gram <= offsets[text + 1]
    position, posting, text = position[inside], posting[inside], text[inside]
    item = index.item[posting]
    diagonal = position - index.place[posting] + int(index.base[-1] if len(index.base) else 0) + (1 << 20)
    band = diagonal // BAND
    # Bands overlap by the edit budget: such hits count in the band before too.
    twice = np.flatnonzero(diagonal - band * BAND < index.edits[item])
    band = np.concatenate([band, band[twice] - 1])
    position, text, item = (np.concatenate([v, v[twice]]) for v in (position, text, item))
    order = np.lexsort((position, text, item, band))
    band, position, text, item = band[order], position[order], text[order], item[order]
    last = np.arange(len(band)) + index.least[item] - 1
    there = last < len(band)
    i, j = np.flatnonzero(there), last[there]
    same = (band[i] == band[j]) & (text[i] == text[j]) & (item[i] == item[j])
    i, j = i[same], j[same]
    close = position[j] - position[i] <= index.region[item[i]] - index.gram
    i, j = i[close], j[close]
    if not len(i):
        return []
    # Overlapping windows of one band are one region.
    new = np.ones(len(i), bool)
    new[1:] = (
        (band[i][1:] != band[i][:-1])
        | (text[i][1:] != text[i][:-1])
        | (item[i][1:] != item[i][:-1])
        | (position[i][1:] > position[j][:-1] + index.gram)
    )
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(i)) - 1
    low, high = position[i[begin]], position[j[end]] + index.gram
    first_diagonal = band[i[begin]] * BAND - (1 << 20) - int(index.base[-1])
    k = item[i[begin]]
    return list(zip(text[i[begin]].tolist(), k.tolist(), low.tolist(), high.tolist(), (first_diagonal + index.base[k]).tolist()))


def aligned(text: np.ndarray, item: np.ndarray, diagonal: int, width: int) -> np.ndarray | None:
    """Edits at every item position on a best path, with text ends free, between the band's diagonals.

    Row r of the table is item position r; column c is text position r + diagonal + c. Item letters beyond the text's
    ends count as edits. Returns per item letter the number of edits spent on it and the path's text position before each
    item letter (one more than the item has), or None if no path lies in the band.
    """
    far = 1 << 20
    rows, columns = len(item), width
    cost = np.full((rows + 1, columns), far, np.int64)
    place = np.arange(columns) + diagonal
    valid = (place >= 0) & (place <= len(text))
    cost[0][valid] = 0
    ramp = np.arange(columns)
    for r in range(1, rows + 1):
        at = place + r  # text position after this row
        ok = (at >= 0) & (at <= len(text))
        before = np.clip(at - 1, 0, max(len(text) - 1, 0))
        miss = text[before] != item[r - 1] if len(text) else np.ones(columns, bool)
        step = cost[r - 1] + np.where((at >= 1) & (at <= len(text)), miss, far)
        skip = np.append(cost[r - 1][1:] + 1, far)  # an item letter without a text letter
        best = np.minimum(np.minimum(step, skip), far)
        # Text letters without an item letter, left to right.
        best = np.minimum.accumulate(best - ramp) + ramp
        cost[r] = np.where(ok, np.minimum(best, far), far)
    spent, at = np.zeros(rows, np.int64), np.zeros(rows + 1, np.int64)
    c = int(np.argmin(cost[rows]))
    if cost[rows][c] >= far:
        return None
    r = rows
    at[r] = r + diagonal + c
    while r:
        here, t = cost[r][c], r + diagonal + c
        diagonal_step = 1 <= t <= len(text) and cost[r - 1][c] + (text[t - 1] != item[r - 1]) == here
        if diagonal_step:
            spent[r - 1] += here - cost[r - 1][c]
            r -= 1
        elif c + 1 < columns and cost[r - 1][c + 1] + 1 == here:
            spent[r - 1] += 1
            r, c = r - 1, c + 1
        elif c and cost[r][c - 1] + 1 == here:
            spent[r - 1] += 1
            c -= 1
            continue
        else:
            return None
        at[r] = r + diagonal + c
    return np.stack([np.append(spent, 0), at])


def distances(text: np.ndarray, item: np.ndarray, diagonal: int, width: int, size: int) -> np.ndarray:
    """Edits of every window of ``size`` item letters at its best place in the text, between the band's diagonals."""
    far = 1 << 20
    starts, ramp = np.arange(len(item) - size + 1)[:, None], np.arange(width)
    at = starts + diagonal + ramp
    cost = np.where((at >= 0) & (at <= len(text)), 0, far)
    for r in range(size):
        at = at + 1
        miss = text[np.clip(at - 1, 0, len(text) - 1)] != item[starts + r]
        step = cost + np.where((at >= 1) & (at <= len(text)), miss, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        best = np.minimum.accumulate(step - ramp, axis=1) + ramp
        cost = np.where((at >= 0) & (at <= len(text)), best, far)
    return cost.min(axis=1)


def verified(data: np.ndarray, start: int, end: int, low: int, high: int, diagonal: int, index: Index, k: int):
    """(text from, text to, item from, item to, edits) of the longest verified stretch of a region, or None."""
    item, size, budget = index.texts[k], int(index.region[k]), int(index.edits[k])
    margin = size
    slack = budget + 1
    width = BAND + budget + 2 * slack
    # No further than the band reaches in the text: its last column enters at the text's start, its first leaves at the end.
    from_item = max(low - diagonal - BAND - budget - margin, start - diagonal + slack + 1 - width, 0)
    to_item = min(high - diagonal + margin, end - diagonal + slack, len(item))
    text, offset = data[start:end], diagonal - start - slack
    path = aligned(text, item[from_item:to_item], offset + from_item, width)
    if path is None or path.shape[1] <= size:
        return None
    spent, at = path[0][:-1], path[1]
    sums = np.concatenate(([0], np.cumsum(spent)))
    good = np.flatnonzero(sums[size:] - sums[:-size] <= budget)
    if not len(good):
        # The best path of the whole is not always the best of each window.
        edits = distances(text, item[from_item:to_item], offset + from_item, width, size)
        if edits.min() > budget:
            return None
        from_item += int(np.argmin(edits))
        spent, at = aligned(text, item[from_item : from_item + size], offset + from_item, width)
        spent = spent[:-1]
        sums, good = np.concatenate(([0], np.cumsum(spent))), np.zeros(1, np.int64)
    # The longest chain of overlapping good windows.
    breaks = np.flatnonzero(np.diff(good) > size)
    heads, tails = np.append(0, breaks + 1), np.append(breaks, len(good) - 1)
    pick = int(np.argmax(good[tails] - good[heads]))
    a, b = int(good[heads[pick]]), int(good[tails[pick]]) + size
    while a < b and spent[a]:
        a += 1
    while b > a and spent[b - 1]:
        b -= 1
    return int(at[a]) + start, int(at[b]) + start, from_item + a, from_item + b, int(sums[b] - sums[a])


def leaks(data: np.ndarray, offsets: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, text from, text to, item from, item to, edits), at most one per text and item."""
    best: dict[tuple[int, int], tuple] = {}
    for text, k, low, high, diagonal in sorted(regions(data, offsets, index), key=lambda r: r[2] - r[3]):
        known = best.get((text, k))
        if known and known[1] - known[0] >= high - low:
            continue
        found = verified(data, int(offsets[text]), int(offsets[text + 1]), low, high, diagonal, index, k)
        if found and (not known or found[1] - found[0] > known[1] - known[0]):
            best[text, k] = found
    if index.whole:
        for text in np.flatnonzero(np.diff(offsets) < index.gram):
            start, end = int(offsets[text]), int(offsets[text + 1])
            for k in index.whole.get(data[start:end].tobytes(), ()):
                best[int(text), k] = (start, end, 0, end - start, 0)
    return [(text, k, *found) for (text, k), found in sorted(best.items())]


_LEAKS = "doc_id bigint, item_id bigint, start bigint, length bigint, item_start bigint, item_length bigint, edits bigint"
_NAMES = [part.split()[0] for part in _LEAKS.split(", ")]


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, block by block; a block holds about ``size`` bytes and is all that is collected."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.octet_length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // size)
    for block in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield sorted(tuple(row) for row in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and benchmark item it holds a stretch of.

    A stretch is a region of 80 code points of the item (the whole item, if shorter) with at most one edit per 16;
    start and length are in code points of the text, item_start and item_length in those of the item. ``docs``
    has doc_id and text, ``benchmark`` item_id and text. Null and empty texts hold nothing and null and empty items are
    in none; an item shorter than a q-gram is held by a text that equals it. Repeated rows give repeated rows. Empty
    tables give no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Index(items))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, data, offsets in chunks(batches, size=_SCAN_BYTES):
                points, offsets = decoded(data, offsets)
                out = leaks(normal(points), offsets, index)
                if not out:
                    continue
                text, item, low, high, item_low, item_high, edits = (np.array(v, np.int64) for v in zip(*out))
                columns = [
                    batch.column("doc_id").take(pa.array(text)),
                    *(pa.array(v) for v in (index.ids[item], low - offsets[text], high - low)),
                    *(pa.array(v) for v in (item_low, item_high - item_low, edits)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

        part = rows.mapInArrow(scan, _LEAKS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], _LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a stretch of the benchmark, all columns kept; no shuffle."""
    for items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in chunks(batches, size=_SCAN_BYTES):
                good = np.ones(batch.num_rows, bool)
                points, offsets = decoded(data, offsets)
                good[[leak[0] for leak in leaks(normal(points), offsets, shared.value)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
