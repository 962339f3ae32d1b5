"""Token ids as Arrow stream files of equal-length sequences with masks, and their way back.

Documents are put in ascending id order and written shard by shard. A shard is a pair of files: ``*.tokens``,
an Arrow stream whose batches hold two fixed-size lists (``input_ids``, and ``mask``, false on the padding of
the shard's last sequence), and ``*.docs``, an Arrow stream with every document's place in the shard. As
all sequences are equally long, sequence ``k`` lies in batch ``k // rows`` at a known place; a reader that maps
the file takes it, or its mask, without copying.

Files are opened through ``pyarrow.fs`` by the URI of the shared folder. Every task attempt writes files of its
own name; only those of attempts that ended well are in the table of shards, so a lost executor or a repeated
task leaves unused files behind and no doubled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostloom.llm.text import chunks
from hostloom.llm.tokens import encoder
from hostloom.session import new_table_path, stored

SEQUENCE_LENGTH = 1024
BATCH_ROWS = 64
_SHARDS = "shard bigint, tokens string, docs string, n_docs bigint, n_tokens bigint, n_sequences bigint"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _token_schema(dtype: np.dtype, length: int) -> pa.Schema:
    ids = pa.list_(pa.field("id", pa.from_numpy_dtype(dtype), nullable=False), length)
    mask = pa.list_(pa.field("real", pa.bool_(), nullable=False), length)
    return pa.schema([pa.field("input_ids", ids, nullable=False), pa.field("mask", mask, nullable=False)])


class _TokenStream:
    """Writes ids as sequences of equal length; the rest waits for the next call or is padded at the end."""

    def __init__(self, sink, dtype: np.dtype, length: int):
        self.schema = _token_schema(dtype, length)
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.length, self.waiting, self.written = length, np.zeros(0, dtype), 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        arrays = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
            for values, field in zip((ids, mask), self.schema)
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.written += len(ids) // self.length

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.waiting, ids])
        step = self.length * BATCH_ROWS
        full = len(ids) // step * step
        for k in range(0, full, step):
            self._batch(ids[k : k + step], step)
        self.waiting = ids[full:]

    def close(self) -> None:
        if len(self.waiting):
            padded = np.zeros(-(-len(self.waiting) // self.length) * self.length, self.waiting.dtype)
            padded[: len(self.waiting)] = self.waiting
            self._batch(padded, len(self.waiting))
        self.writer.close()


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, length: int = SEQUENCE_LENGTH
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order; returns the table of shards.

    A null text counts as empty. A null doc_id comes first; equal doc_ids are ordered by text, and
    repeated rows are all kept. An empty table gives no shard. Other columns are left alone.
    """
    spark = docs.sparkSession
    folder = folder or new_table_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def all_batches():
            yield first
            yield from batches

        task = TaskContext.get()
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"{task.partitionId():07d}-{task.taskAttemptId()}"
        encode = encoder(tokenizer)
        count = total = 0
        with (
            files.open_output_stream(f"{path}/{name}.tokens") as token_sink,
            files.open_output_stream(f"{path}/{name}.docs") as doc_sink,
            pa.ipc.new_stream(doc_sink, _DOCS) as doc_writer,
        ):
            stream = _TokenStream(token_sink, encode.dtype, length)
            for batch, data, offsets in chunks(all_batches()):
                ids, bounds = encode.encode(data, offsets, end_id)
                stream.add(ids)
                places = [batch.column("doc_id"), pa.array(bounds[:-1] + total), pa.array(np.diff(bounds))]
                doc_writer.write_batch(pa.RecordBatch.from_arrays(places, schema=_DOCS))
                count, total = count + batch.num_rows, total + len(ids)
            stream.close()
        shard = [task.partitionId(), f"{folder}/{name}.tokens", f"{folder}/{name}.docs", count, total, stream.written]
        names = ("shard", "tokens", "docs", "n_docs", "n_tokens", "n_sequences")
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, shard)})

    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return stored(ordered.mapInArrow(write, _SHARDS), "token-shards")


class TokenFile:
    """Random access to the sequences of one token file; a local file is mapped and not copied."""

    def __init__(self, path: str):
        files, inner = fs.FileSystem.from_uri(path)
        if isinstance(files, fs.LocalFileSystem):
            self.source = pa.memory_map(inner)
        else:
            with files.open_input_stream(inner) as stream:
                self.source = pa.BufferReader(stream.read())
        reader = pa.ipc.open_stream(self.source)
        self.batches = list(reader)
        self.length = reader.schema.field("input_ids").type.list_size
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> np.ndarray:
        """Ids of sequence ``k``, a view of the file."""
        batch = self.batches[k // self.rows]
        values = batch.column("input_ids").values
        return values.to_numpy()[k % self.rows * self.length :][: self.length]

    def mask(self, k: int) -> pa.BooleanArray:
        """Mask of sequence ``k`` as an Arrow view; its bits need no copy."""
        batch = self.batches[k // self.rows]
        return batch.column("mask").values.slice(k % self.rows * self.length, self.length)

    def blocks(self) -> Iterator[np.ndarray]:
        """The unmasked ids, batch by batch; only the end of the last batch is padding."""
        for batch in self.batches:
            ids, real = batch.column("input_ids").values.to_numpy(), batch.column("mask").values.true_count
            yield ids[:real]


def read_token_files(shards: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start among all ids, n_tokens, ids (little-endian 32-bit)."""
    places = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(places), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                yield from _documents(shard["tokens"], shard["docs"], shard["base"])

    count = max(shards.count(), 1)
    return based.repartition(count).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _documents(tokens: str, docs: str, base: int) -> Iterator[pa.RecordBatch]:
    blocks = TokenFile(tokens).blocks()
    held, held_from = np.zeros(0, "<u4"), 0
    files, inner = fs.FileSystem.from_uri(docs)
    with files.open_input_stream(inner) as stream:
        for batch in pa.ipc.open_stream(stream):
            starts, counts = batch.column("start").to_numpy(), batch.column("n_tokens").to_numpy()
            end = int(starts[-1] + counts[-1])
            parts = [held]
            have = held_from + len(held)
            while have < end:
                parts.append(next(blocks).astype("<u4"))
                have += len(parts[-1])
            held = np.concatenate(parts)
            at = starts - held_from
            offsets = np.append(at, at[-1] + counts[-1])
            ids = pa.Array.from_buffers(
                pa.binary(),
                len(starts),
                [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32) * 4), pa.py_buffer(held[offsets[0] : offsets[-1]].tobytes())],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(starts + base), batch.column("n_tokens"), ids],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            held, held_from = held[offsets[-1] :], end


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    return digests(read_token_files(write_token_files(docs, tokenizer)))


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table of shards."""
    return spark.read.schema(_SHARDS).parquet(path)


def crc32_of(ids) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers, for one document at hand."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
