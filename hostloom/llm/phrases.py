"""Substring dedup by repeated-phrase automata.

A window is 13 consecutive words. Its anchor is the smallest hash among its runs of 5 words, so equal windows have
equal anchors, and consecutive windows with one anchor form a run.

1. Exact copies are known by their digests. Documents are shuffled once, and all later steps read that shuffle.
2. Anchors of all other documents are shuffled, equal ones of a task's stretch of text as one row; those that occur in
   one document only fall out. An anchor with very many runs is hot: its windows are runs of their own from here on.
3. The words of every recurring run go to the shard of their anchor (a hot window's to a shard of its own), equal ones of
   a stretch as one row. There, windows found in two documents are confirmed, compiled into Aho-Corasick automata of
   bounded size, and the runs of all documents stream through them.
4. Every run gets the first document of each of its windows back, which decides what its document loses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.text import chunks, gram_hashes, mixed, runs, span_hashes, words
from hostloom.session import stored

WINDOW = 13
ANCHOR = 5
AUTOMATON_PHRASES = 20_000
# Runs of anchors with more runs than this in the corpus are split into their windows.
HOT_RUNS = 10_000
# Equal anchors, and equal contexts, of a task are combined over this many runs, and bytes of words.
STRETCH_RUNS, STRETCH_BYTES = 1 << 20, 32 << 20


def window_runs(data: np.ndarray, offsets: np.ndarray):
    """Words and runs of a chunk: (starts, ends, hashes, first word of each text, run's first window,
    number of windows, text of the run, anchor)."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    grams = gram_hashes(hashes, ANCHOR)
    none = np.zeros(0, np.int64)
    if len(hashes) < WINDOW:
        return starts, ends, hashes, first, none, none, none, none.astype(np.uint64)
    # Position in the low bits: of equal hashes the leftmost is taken, wherever the window lies.
    low = np.uint64((1 << 28) - 1)
    value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, WINDOW - ANCHOR + 1
    while span < width:
        step = min(span, width - span)
        value = np.minimum(value[:-step], value[step:])
        span += step
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(owner[: len(value)] == owner[WINDOW - 1 : WINDOW - 1 + len(value)])
    at = (value[inside] & low).astype(np.int64)
    new = np.ones(len(inside), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(inside) != 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(inside)))
    run_first = inside[begin]
    return starts, ends, hashes, first, run_first, count, owner[run_first], grams[at[begin]]


_ANCHORS = "key bigint, n bigint, low bigint, high bigint, docs array<bigint>"


def _anchor_rows(anchor: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """One row per different anchor: number of its runs, smallest document; if there are several, the largest and all."""
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    new = np.append(True, anchor[1:] != anchor[:-1])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(anchor)))
    last = doc[heads + size - 1]
    several = doc[heads] < last
    listed = np.repeat(several, size) & (new | np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(0, np.cumsum(np.add.reduceat(listed.astype(np.int32), heads))).astype(np.int32)
    docs = pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[listed]), mask=pa.array(~several))
    columns = [anchor[heads].view(np.int64), size, doc[heads], pa.array(last, mask=~several), docs]
    return pa.record_batch(columns, ["key", "n", "low", "high", "docs"])


def _recurring(rows: DataFrame) -> DataFrame:
    """doc_id, anchors, hot: per document its anchors that occur in a document with another id, and the hot ones.

    Copies have their result already and take no part.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        heads = (batch.filter(pc.and_not(batch.column("doc_id").is_valid(), batch.column("copy"))) for batch in batches)
        for batch, data, offsets in chunks(heads):
            *_, text, anchor = window_runs(data, offsets)
            held.append((anchor, batch.column("doc_id").to_numpy(zero_copy_only=False)[text].astype(np.int64)))
            size += len(anchor)
            if size >= STRETCH_RUNS:
                yield _anchor_rows(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            yield _anchor_rows(*map(np.concatenate, zip(*held)))

    # A key has one row per stretch of text that holds it, however many its documents.
    same = Window.partitionBy("key")
    last = F.max(F.coalesce("high", "low")).over(same)
    between = {"first": F.min("low").over(same), "last": last, "total": F.sum("n").over(same)}
    seen = rows.mapInArrow(anchors, _ANCHORS).withColumns(between)
    doc = F.explode(F.coalesce("docs", F.array("low"))).alias("doc_id")
    found = seen.filter("first < last").select(doc, "key", F.when(F.col("total") > HOT_RUNS, F.col("key")).alias("hot"))
    return found.groupBy("doc_id").agg(F.collect_list("key").alias("anchors"), F.collect_list("hot").alias("hot"))


def _kept(raw: bytes) -> str:
    return hashlib.sha256(b" ".join(raw.split())).hexdigest()


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text, rest, text_hash, copy (an equal text has a smaller doc_id), anchors (recurring ones), hot.

    Every step reads all columns of this frame, so that Spark makes it, and its shuffle of the texts, once.
    """
    named = docs.filter("doc_id is not null")
    ids = stored(named.select("doc_id", F.sha2("text", 256).alias("digest")), "phrase-ids")
    least = ids.groupBy("digest").agg(F.min("doc_id").alias("head"))
    copies = ids.join(least, "digest").filter("doc_id > head")
    copies = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    copy = F.coalesce(F.array_contains("copied", F.sha2("text", 256)), F.lit(False)).alias("copy")
    text_hash = F.xxhash64("text").alias("text_hash")
    rows = docs.join(copies, "doc_id", "left").select("doc_id", "text", "rest", text_hash, copy)
    # Both joins are by document, so that texts are shuffled once.
    return rows.join(_recurring(rows), "doc_id", "left")


def _run_rows(batches: Iterator[pa.RecordBatch]):
    """Recurring runs of a chunk: per run its text row, first window, number of windows, anchor, 128-bit id and
    the place of its words. A hot run comes as its windows, each with its id as anchor."""
    waiting = (batch.filter(pc.and_not(batch.column("anchors").is_valid(), batch.column("copy"))) for batch in batches)
    for batch, data, offsets in chunks(waiting):
        starts, ends, hashes, first, run_first, count, text, anchor = window_runs(data, offsets)
        # Whether an anchor recurs or is hot is the same for all documents.
        recurring, many = (batch.column(c).flatten().to_numpy().view(np.uint64) for c in ("anchors", "hot"))
        keep = np.flatnonzero(np.isin(anchor, recurring))
        run_first, count, text, anchor = run_first[keep], count[keep], text[keep], anchor[keep]
        hot = np.isin(anchor, many)
        if hot.any():
            times = np.where(hot, count, 1)
            run_first = np.repeat(run_first, times) + runs(times)
            count = np.repeat(np.where(hot, 1, count), times)
            text, anchor, hot = (np.repeat(v, times) for v in (text, anchor, hot))
        size = count + WINDOW - 1
        word = np.repeat(run_first, size) + runs(size)
        mark = mixed(runs(size).astype(np.uint64) + np.uint64(77))
        cut = np.cumsum(size) - size
        ids = [
            mixed(np.add.reduceat(mixed(hashes[word] ^ m), cut) + size.astype(np.uint64)) if len(cut) else anchor
            for m in (mark, mixed(mark))
        ]
        yield batch, data, (starts, ends), first, run_first, count, text, np.where(hot, ids[0], anchor), ids


def _places(rows: DataFrame) -> DataFrame:
    """Where every recurring run lies: id_a, id_b, doc_id, text_hash, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, first, run_first, _, text, _, ids in _run_rows(batches):
            place = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[0].view(np.int64)),
                    pa.array(ids[1].view(np.int64)),
                    batch.column("doc_id").take(place),
                    batch.column("text_hash").take(place),
                    pa.array((run_first - first[text]).astype(np.int32)),
                ],
                names=["id_a", "id_b", "doc_id", "text_hash", "start"],
            )

    return rows.mapInArrow(run, "id_a bigint, id_b bigint, doc_id bigint, text_hash bigint, start int")


_CONTEXT = "id_a bigint, id_b bigint, anchor bigint, low bigint, high bigint, run string"


def _combined(id_a, id_b, anchor, low, high, run: pa.Array) -> pa.RecordBatch:
    """Equal runs as one row."""
    order = np.lexsort((id_b, id_a))
    a, b = id_a[order], id_b[order]
    opens = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    pick = order[opens]
    columns = [
        pa.array(a[opens].view(np.int64)),
        pa.array(b[opens].view(np.int64)),
        pa.array(anchor[pick].view(np.int64)),
        pa.array(np.minimum.reduceat(low[order], opens)),
        pa.array(np.maximum.reduceat(high[order], opens)),
        run.take(pa.array(pick)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["id_a", "id_b", "anchor", "low", "high", "run"])


def _contexts(rows: DataFrame) -> DataFrame:
    """Every different run of a stretch of text once: its words joined by spaces, smallest and largest doc_id."""

    def joined(held: list[tuple]) -> pa.RecordBatch:
        *numbers, texts = zip(*held)
        return _combined(*map(np.concatenate, numbers), pa.concat_arrays(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, data, (starts, ends), _, run_first, count, text, anchor, ids in _run_rows(batches):
            if not len(count):
                continue
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[text].astype(np.int64)
            order = np.lexsort((ids[1], ids[0]))
            a, b = ids[0][order], ids[1][order]
            opens = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            pick = order[opens]
            raw = data.tobytes()
            begin, end = starts[run_first[pick]].tolist(), ends[run_first[pick] + count[pick] + WINDOW - 2].tolist()
            phrases = pa.array([b" ".join(raw[x:y].split()).decode() for x, y in zip(begin, end)], pa.string())
            low, high = np.minimum.reduceat(doc[order], opens), np.maximum.reduceat(doc[order], opens)
            held.append((a[opens], b[opens], anchor[pick], low, high, phrases))
            size += phrases.nbytes
            if size >= STRETCH_BYTES:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    return rows.mapInArrow(run, _CONTEXT)


class _Shard:
    """Confirmed phrases of some anchors, and the runs to stream through their automaton.

    Words are numbered within the shard; the automaton's letters are these numbers, so a match is one of whole words.
    """

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.phrases: dict[tuple[int, ...], int] = {}
        self.runs: list[tuple] = []

    def add(self, group: list[tuple]) -> None:
        """Take one anchor's runs: (id_a, id_b, low, high, words)."""
        if len(group) == 1 and group[0][2] == group[0][3]:
            return
        number = self.numbers.setdefault
        seen: dict[tuple[int, ...], list[int]] = {}
        coded = []
        for id_a, id_b, low, high, run in group:
            letters = tuple([number(w, len(self.numbers) + 1) for w in run.split(" ")])
            coded.append((id_a, id_b, letters))
            for k in range(len(letters) - WINDOW + 1):
                window = letters[k : k + WINDOW]
                ends = seen.get(window)
                if ends is None:
                    seen[window] = [low, high]
                else:
                    ends[0], ends[1] = min(ends[0], low), max(ends[1], high)
        confirmed = {window: low for window, (low, high) in seen.items() if low < high}
        if confirmed:
            self.phrases.update(confirmed)
            self.runs += coded

    def occurrences(self) -> pa.RecordBatch:
        """For every run the first document of each of its windows, null where the window is in one only."""
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, first in self.phrases.items():
            automaton.add_word(phrase, first)
        automaton.make_automaton()
        rows = []
        for id_a, id_b, letters in self.runs:
            firsts = [None] * (len(letters) - WINDOW + 1)
            for end, first in automaton.iter(letters):
                firsts[end - WINDOW + 1] = first
            if any(f is not None for f in firsts):
                rows.append((id_a, id_b, firsts))
        columns = list(zip(*rows)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["id_a", "id_b", "firsts"]
        )


def _located(contexts: DataFrame) -> DataFrame:
    """id_a, id_b, firsts: what the automata find in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, current = _Shard(), {}, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "id_a", "id_b", "low", "high", "run")]
            for anchor, id_a, id_b, low, high, text in zip(*columns):
                if anchor != current:
                    shard.add(list(group.values()))
                    group, current = {}, anchor
                    if len(shard.phrases) >= AUTOMATON_PHRASES:
                        yield shard.occurrences()
                        shard = _Shard()
                known = group.get((id_a, id_b))
                if known:
                    low, high = min(low, known[2]), max(high, known[3])
                group[id_a, id_b] = (id_a, id_b, low, high, text)
        shard.add(list(group.values()))
        if shard.runs:
            yield shard.occurrences()

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "id_a bigint, id_b bigint, firsts array<bigint>")


def _covered(batch: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
    """Which words of a chunk are covered by a window that an earlier document has."""
    out = np.zeros(first[-1] + 1, np.int64)
    hits = batch.column("hits")
    found = hits.flatten()
    if len(found):
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(hits), 0).to_numpy())
        text, start = (found.field(name).to_numpy() for name in ("text_hash", "start"))
        firsts = found.field("firsts")
        count = pc.list_value_length(firsts).to_numpy()
        # Hits are of documents with an id, and ids lie below this.
        earliest = pc.fill_null(firsts.flatten(), np.iinfo(np.int64).max).to_numpy()
        doc = pc.fill_null(batch.column("doc_id"), 0).to_numpy()[row]
        own = text == batch.column("text_hash").to_numpy()[row]  # a doc_id may have several texts
        gone = np.repeat(own, count) & (earliest < np.repeat(doc, count))
        window = (np.repeat(first[row] + start, count) + runs(count))[gone]
        np.add.at(out, window, 1)
        np.add.at(out, window + WINDOW, -1)
    return np.cumsum(out)[:-1] > 0


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, rest: every document without the words that earlier ones have.

    ``docs`` has doc_id and text. A word is removed if a window over it also starts in a document with a smaller
    doc_id. kept_text is the untouched text (null stays null) where nothing is removed, else the kept words joined
    by single spaces. Rows without doc_id are neither searched nor cut. Rows that share a doc_id never cut
    each other. Further columns come back in the struct ``rest``, whatever their names. An empty table gives no row.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest.alias("rest"))
    read = _read(docs)
    hits = _places(read).join(_located(_contexts(read)), ["id_a", "id_b"])
    hits = hits.filter(F.array_min("firsts") < F.col("doc_id"))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "start", "firsts")).alias("hits"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            starts, ends, first = words(data, offsets)
            count = np.diff(first)
            gone = _covered(batch, first)
            copied = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (count >= WINDOW)
            gone |= np.repeat(copied, count)
            removed = np.diff(np.append(0, np.cumsum(gone))[first])
            changed, texts = np.flatnonzero(removed), []
            for row in changed.tolist():
                kept = np.flatnonzero(~gone[first[row] : first[row + 1]]) + first[row]
                raw, base = data[offsets[row] : offsets[row + 1]].tobytes(), int(offsets[row])
                spans = zip((starts[kept] - base).tolist(), (ends[kept] - base).tolist())
                texts.append(b" ".join([raw[x:y] for x, y in spans]).decode())
            text = batch.column("text")
            source = np.arange(len(text))
            source[changed] = len(text) + np.arange(len(changed))
            kept_text = pa.concat_arrays([text, pa.array(texts, text.type)]).take(pa.array(source))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count), pa.array(removed), kept_text, batch.column("rest")],
                names=["doc_id", "n_words", "n_removed", "kept_text", "rest"],
            )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, rest "
    return read.join(hits, "doc_id", "left").mapInArrow(cut, schema + read.schema["rest"].dataType.simpleString())


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_kept((t or "").encode()) for t in batch.column("kept_text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_removed")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
            )

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
