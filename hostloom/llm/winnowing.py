"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every window of w of them the smallest, the rightmost of
equal ones, is selected with its position. Any passage of at least w + k - 1 code points that two texts share
gives them a selected hash in common. Selected positions are at most w apart, so a gap fits in one byte: a
fingerprint is the Base64 text of 5 bytes (hash, gap) per selection.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.text import mixed

GRAM = 16
WINDOW = 25  # shared passages of 40 code points and more are found

_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)  # an array: its products wrap silently
_LOW = np.uint64(0xFFFFFFFF)
_ENTRY = np.dtype([("hash", ">u4"), ("gap", "u1")])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_codes(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hash of every k-gram, from hashes of runs whose length doubles."""
    count = len(points) - gram + 1
    total, size, power = None, 0, points.astype(np.uint64) + np.uint64(1)
    length, factor, step = 1, _BASE, gram
    while step:
        if step & 1:
            if total is None:
                total, size = power[:count], length
            else:
                total = total * factor + power[size : size + count]
                size += length
        step >>= 1
        if step:
            power = power[:-length] * factor + power[length:]
            length, factor = length * 2, factor * factor
    return mixed(total) >> np.uint64(32)


def select(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected hashes and positions. A text shorter than ``gram`` is one gram; an empty text has none."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = gram_codes(points, min(gram, len(points)))
    # The reversed position in the low half makes the rightmost of equal hashes the smallest.
    value = (codes << np.uint64(32)) | (_LOW - np.arange(len(codes), dtype=np.uint64))
    span = 1
    window = min(window, len(codes))
    while span < window:
        step = min(span, window - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    chosen = value[np.append(True, value[1:] != value[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW - (chosen & _LOW)).astype(np.int64)


def encoded(hashes: np.ndarray, positions: np.ndarray) -> str:
    entries = np.empty(len(hashes), _ENTRY)
    entries["hash"] = hashes
    entries["gap"] = np.diff(positions, prepend=0)
    return base64.b64encode(entries.tobytes()).decode()


def decoded(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, position) of every selection."""
    entries = np.frombuffer(base64.b64decode(fingerprint), _ENTRY)
    return list(zip(entries["hash"].tolist(), np.cumsum(entries["gap"], dtype=np.int64).tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two ascending arrays of distinct hashes; two empty ones are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, fingerprint of every text; null counts as empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [code_points(t or "") for t in batch.column("text").to_pylist()]
            out = [encoded(*select(p, gram, window)) for p in points]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(p) for p in points], pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


# --- texts against their successors

_NO_ID = -(1 << 63)


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """bucket, guest, place, doc_id, text: documents in buckets of ascending id, for one pass over each.

    The first document of a bucket is also the last guest of the bucket before (that of the first bucket:
    of the last one), so every document meets its successor. Bucket limits are quantiles of the ids; there are a few
    times as many buckets as shuffle partitions, which bounds the table of first documents that is broadcast.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col("doc_id").cast("bigint")
    place = F.coalesce(doc_id, F.lit(_NO_ID))
    ids = docs.select(place.alias("place"), place.cast("double").alias("at"))
    cuts = ids.approxQuantile("at", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="at", outputCol="bucket")
    firsts = sorted(tuple(r) for r in bucketizer.transform(ids).groupBy("bucket").agg(F.min("place")).collect())
    before = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    guests = spark.createDataFrame(before, "place bigint, guest_of double")
    rows = docs.select(doc_id.alias("doc_id"), "text", place.alias("place"), place.cast("double").alias("at"))
    rows = bucketizer.transform(rows).join(F.broadcast(guests), "place", "left")
    own = F.struct("bucket", F.lit(False).alias("guest"))
    visit = F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))
    copies = F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, visit))
    dealt = rows.select("place", "doc_id", "text", F.explode(copies).alias("c"))
    dealt = dealt.select(F.col("c.bucket").alias("bucket"), F.col("c.guest").alias("guest"), "place", "doc_id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", "place", "text")


_EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_and_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or all) of the
    next document in ascending doc_id, after the last the first. A null text counts as empty; a null doc_id comes
    first; equal doc_ids are ordered by text; a single document is its own successor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, points, hashes, positions, set) of the row before
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")]
            for bucket, guest, doc_id, text in zip(*columns):
                if guest and (held is None or held[0] != bucket):
                    continue  # further rows with the first document's id
                points = code_points(text or "")
                hashes, positions = select(points, gram, window)
                own = np.unique(hashes)
                if held is not None and held[0] == bucket:
                    rows.append(_compared(*held[1:], points, own, gram, window))
                held = None if guest else (bucket, doc_id, points, hashes, positions, own)
            if rows:
                yield pa.RecordBatch.from_pydict({n: list(v) for n, v in zip(_NAMES, zip(*rows))}, schema=_SCHEMA)

    return in_order(docs, buckets).mapInArrow(run, _EDITED)


_NAMES = [part.split()[0] for part in _EDITED.split(", ")]
_SCHEMA = pa.schema(
    [
        (part.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[part.split()[1]])
        for part in _EDITED.split(", ")
    ]
)


def _compared(doc_id, points, hashes, positions, own, next_points, next_own, gram: int, window: int) -> tuple:
    half = len(points) // 2
    changed = np.concatenate([points[: len(points) - half], next_points[:half]])
    new_hashes, new_positions = select(changed, gram, window)
    edited = changed.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return (
        doc_id,
        len(points),
        hashlib.sha256(edited).hexdigest(),
        encoded(hashes, positions),
        encoded(new_hashes, new_positions),
        likeness(own, np.unique(new_hashes)),
        likeness(own, next_own),
    )
