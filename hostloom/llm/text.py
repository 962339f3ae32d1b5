"""Vectorised text helpers for use inside tasks: byte views of Arrow strings, word spans, hashes.

All functions work on chunks of a few MB, so their temporary arrays stay bounded whatever the size of a
partition; one very long text forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from hostloom.session import ship_package

CHUNK_BYTES = 4 << 20
ARROW_ROWS = 1000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Word separators: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32

_random = np.random.default_rng(20160422)
_BYTES = (
    _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1),
    _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1),
)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def prepared(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and batches of texts small.

    The default of 10,000 rows a batch holds tens of MB of text several times over, in the worker and in the executor
    beside its heap; 1,000 rows are about a chunk. Another setting than the default is left alone.
    """
    ship_package(spark)
    if spark.conf.get(_ROWS_SETTING) == "10000":
        spark.conf.set(_ROWS_SETTING, str(ARROW_ROWS))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each text in them; null counts as empty."""
    filled = pc.fill_null(column, "") if column.null_count else column
    count = len(filled)
    kind = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    offsets = np.frombuffer(filled.buffers()[1], kind)[filled.offset : filled.offset + count + 1].astype(np.int64)
    data = filled.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices whose texts hold at most ``size`` bytes (or one text), with their bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield (
                batch.slice(row, end - row),
                data[offsets[row] : offsets[end]],
                offsets[row : end + 1] - offsets[row],
            )
            row = end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
    """Start and end of every word and the first word number of every text (with the total at the end)."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def _power_table(which: int, length: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64."""
    table = _powers.get(which)
    if table is None or len(table) < length:
        factors = np.full(max(length, 64), _BASES[which], np.uint64)
        factors[0] = 1
        table = _powers[which] = np.multiply.accumulate(factors)
    return table


_BLOCK_BYTES = 1 << 17


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of every byte span, 0 for empty ones; spans are in order and do not overlap.

    Works block by block, so that the wide temporary arrays stay in the processor's cache.
    """
    filled = np.flatnonzero(ends > starts)
    if len(filled) < len(starts):
        out = np.zeros(len(starts), np.uint64)
        if len(filled):
            out[filled] = span_hashes(data, starts[filled], ends[filled], which)
        return out
    out = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        upto = max(int(np.searchsorted(ends, starts[done] + _BLOCK_BYTES)), done + 1)
        first = int(starts[done])
        begin, lengths = starts[done:upto] - first, ends[done:upto] - starts[done:upto]
        block = data[first : ends[upto - 1]]
        values = _BYTES[which][block]
        total = np.cumsum(lengths)
        place = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
        if total[-1] != len(block):
            values = values[place + np.repeat(begin, lengths)]
        values *= _power_table(which, int(lengths.max()) + 1)[place]
        out[done:upto] = np.add.reduceat(values, total - lengths) + lengths.astype(np.uint64)
        done = upto
    return mixed(out)


def gram_hashes(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries; shorter by ``size - 1`` than the input."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(_BASES[which])
    total = hashes[:count].copy()
    for k in range(1, size):
        total *= base
        total += hashes[k : k + count]
    return mixed(total)


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)
