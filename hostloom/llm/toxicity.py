"""Toxicity by the nearest labelled examples.

Terms are words and their first 4, 5 and 6 letters. Of the labelled training rows (a bounded sample) those terms are
kept whose occurrence goes with the label beyond chance; they span the TF-IDF space. Labelled examples lie in
a block-max inverted index: a term's postings are cut into blocks of examples with the largest weight of each, whose sums
bound the cosine of a whole block, so blocks that cannot reach the k-th best are never scored. The result is the
exact k nearest. Their votes, weighted by distance, are mapped to probabilities by isotonic regression on
the examples' own leave-one-out votes; the neighbours are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.llm.decontamination import normal
from hostloom.llm.labelled import held_out, sampled, training_labels
from hostloom.llm.text import chunks, span_hashes, words
from hostloom.session import stored

MAX_LABELLED = 12_000  # labelled rows used to fit
NEIGHBOURS = 15
BLOCK = 32
PREFIXES = (4, 5, 6)
LEAST_LIFT = 16.0

_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def term_counts(data: np.ndarray, offsets: np.ndarray):
    """(text, term hash, count) of all texts of a chunk, sorted by text and term."""
    lower = normal(data)
    starts, ends, first = words(lower, offsets, _NOT_LETTER)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    codes, texts = [span_hashes(lower, starts, ends)], [owner]
    opens = np.flatnonzero((lower & 0xC0) != 0x80)  # first byte of every code point
    rank = np.searchsorted(opens, starts)
    letters = np.searchsorted(opens, ends) - rank
    opens = np.append(opens, len(lower))
    for size in PREFIXES:
        long = np.flatnonzero(letters > size)
        cut = opens[rank[long] + size]
        codes.append(span_hashes(lower, starts[long], cut) ^ np.uint64(size))
        texts.append(owner[long])
    code, text = np.concatenate(codes), np.concatenate(texts)
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], code[begin], np.diff(np.append(begin, len(code)))


def _term_frequencies(rows: DataFrame) -> DataFrame:
    """term, n_docs, n_positive over labelled rows (text, label), combined per chunk before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            text, code, _ = term_counts(data, offsets)
            label = batch.column("label").to_numpy(zero_copy_only=False)[text]
            terms, inverse = np.unique(code, return_inverse=True)
            positive = np.bincount(inverse, weights=label, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms.view(np.int64)),
                    pa.array(np.bincount(inverse, minlength=len(terms)).astype(np.int64)),
                    pa.array(positive),
                ],
                names=["term", "n_docs", "n_positive"],
            )

    counted = rows.select("text", "label").mapInArrow(run, "term bigint, n_docs bigint, n_positive bigint")
    return counted.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_positive").alias("n_positive"))


def telling_terms(frequencies: DataFrame, documents: int, positives: int) -> DataFrame:
    """Terms that go with the label: at least ``LEAST_LIFT`` times as frequent among positive rows, with a
    likelihood ratio at which chance would give at most a tenth of as many terms (its tail is below exp(-ratio / 2))."""
    a = F.col("n_positive").cast("double")
    b = (F.col("n_docs") - F.col("n_positive")).cast("double")
    n, p = float(max(documents, 1)), float(max(positives, 1))
    q = max(n - p, 1.0)
    share = F.col("n_docs") / n

    def part(k, size):
        rate = k / size
        log = F.when(k > 0, k * F.log(rate / share)).otherwise(0.0)
        rest = size - k
        return log + F.when((rest > 0) & (share < 1), rest * F.log((1 - rate) / (1 - share))).otherwise(0.0)

    lift = ((a + 0.5) / (p + 1)) / ((b + 0.5) / (q + 1))
    rated = frequencies.withColumns({"ratio": 2 * (part(a, p) + part(b, q)), "lift": lift})
    # Counts by whole-numbered ratio: one row per value.
    level = F.when(F.col("lift") >= LEAST_LIFT, F.floor("ratio")).otherwise(-1)
    counts = {r["level"]: r["count"] for r in rated.groupBy(level.alias("level")).count().collect()}
    terms, above, cutoff = sum(counts.values()), 0, float("inf")
    for value in sorted((v for v in counts if v is not None and v >= 0), reverse=True):
        above += counts[value]
        if terms * np.exp(-value / 2) <= 0.1 * above:
            cutoff = float(value)
    return rated.filter((F.col("ratio") >= cutoff) & (F.col("lift") >= LEAST_LIFT))


class BlockMaxIndex:
    """Exact cosine search over sparse unit vectors."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK):
        """``rows``: term numbers and weights of every example; similar ones should be neighbours."""
        self.size, self.block = len(rows), block
        self.blocks = -(-len(rows) // block)
        counts = [len(t) for t, _ in rows]
        doc = np.repeat(np.arange(len(rows)), counts)
        term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        order = np.lexsort((doc, term))
        doc, term, weight = doc[order], term[order], weight[order]
        self.bounds = np.searchsorted(term, np.arange(terms + 1))
        self.doc, self.weight = doc, weight
        # Per term its blocks, where each begins in the postings, and the largest weight in it.
        key = term * max(self.blocks, 1) + doc // block
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.block_begin = np.append(begin, len(key))
        self.block_number = (doc // block)[begin]
        self.block_max = np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0)
        self.block_bounds = np.searchsorted(term[begin], np.arange(terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1):
        """The k examples of largest cosine above 0 (ties: first ones): numbers and cosines.

        ``without`` leaves one example out.
        """
        bound = np.zeros(self.blocks)
        for t, w in zip(terms, weights):
            a, b = self.block_bounds[t], self.block_bounds[t + 1]
            bound[self.block_number[a:b]] += w * self.block_max[a:b]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        scores: dict[int, float] = {}
        kth, done, wave = 0.0, 0, 8
        while done < len(order) and (len(scores) < k or bound[order[done]] >= kth - 1e-12):
            chosen = np.sort(order[done : done + wave])
            sums = np.zeros(len(chosen) * self.block)
            for t, w in zip(terms, weights):
                a, b = self.block_bounds[t], self.block_bounds[t + 1]
                mine = self.block_number[a:b]
                at = np.searchsorted(mine, chosen)
                there = np.flatnonzero(at < b - a)
                there = there[mine[at[there]] == chosen[there]]
                for c in there:
                    x, y = self.block_begin[a + at[c]], self.block_begin[a + at[c] + 1]
                    sums[self.doc[x:y] - chosen[c] * self.block + c * self.block] += w * self.weight[x:y]
            for place in np.flatnonzero(sums > 0):
                number = int(chosen[place // self.block] * self.block + place % self.block)
                if number != without:
                    scores[number] = float(sums[place])
            if len(scores) >= k:
                best = sorted(scores.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
                scores, kth = dict(best), best[-1][1]
            done, wave = done + wave, wave * 2
        best = sorted(scores.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
        return np.array([n for n, _ in best], np.int64), np.array([s for _, s in best])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing step function of least squares (pool adjacent violators): knots and values."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, largest x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][2] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], last[2]]
    knots = np.array([b[2] for b in blocks])
    values = np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks])
    return knots, np.maximum.accumulate(values) if len(values) else values


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # their IDF
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    elsewhere: float  # score of texts without any term

    def vector(self, codes: np.ndarray, counts: np.ndarray):
        """Term numbers and unit weights of one text; ``codes`` are sorted."""
        at = np.minimum(np.searchsorted(self.terms, codes), max(len(self.terms) - 1, 0))
        known = self.terms[at] == codes if len(self.terms) else np.zeros(len(codes), bool)
        number = at[known]
        weight = (1 + np.log(counts[known])) * self.weights[number]
        return number, weight / max(np.sqrt((weight**2).sum()), 1e-12)

    def vote(self, terms, weights, without: int = -1):
        near, cosine = self.index.search(terms, weights, NEIGHBOURS, without)
        if not len(near):
            return None, near, cosine
        nearness = 1 / (1 - np.minimum(cosine, 1) + 0.05)
        return float((nearness * self.labels[near]).sum() / nearness.sum()), near, cosine

    def score(self, vote: float | None) -> float:
        if vote is None:
            return self.elsewhere
        return float(self.values[min(np.searchsorted(self.knots, vote), len(self.values) - 1)])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Learn from at most about ``limit`` labelled training rows; ``labels`` has doc_id and toxic."""
    chosen = sampled(training_labels(labels, "toxic"), limit)
    # The sample is bounded by ``limit``, so it may be broadcast.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = stored(rows.select("doc_id", "text", "label"), "toxicity-labelled")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).first()
    found = telling_terms(stored(_term_frequencies(rows), "toxicity-terms"), size["n"], size["p"])
    found = sorted((r["term"] % (1 << 64), r["n_docs"]) for r in found.collect())
    terms = np.array([t for t, _ in found], np.uint64)
    weights = np.log((1 + size["n"]) / (1 + np.array([d for _, d in found], float))) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            text, code, count = term_counts(data, offsets)
            known = np.isin(code, terms)
            text, code, count = text[known], code[known], count[known]
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(code.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(count.astype(np.int32))),
                ],
                names=["doc_id", "label", "codes", "counts"],
            )

    schema = "doc_id bigint, label int, codes array<bigint>, counts array<int>"
    examples = rows.mapInArrow(vectors, schema).filter(F.size("codes") > 0).collect()  # of the bounded sample
    model = Model(terms, weights, None, None, None, np.zeros(1), np.zeros(1), 0.0)
    built = []
    for e in examples:
        number, weight = model.vector(np.array(e["codes"], np.int64).view(np.uint64), np.array(e["counts"]))
        built.append((number.tolist(), e["doc_id"], e["label"], weight))
    built.sort(key=lambda b: b[:2])  # examples with equal terms share blocks
    model.index = BlockMaxIndex([(np.array(t, np.int64), w) for t, _, _, w in built], len(terms))
    model.ids = np.array([d for _, d, _, _ in built], np.int64)
    model.labels = np.array([y for _, _, y, _ in built], float)
    rest, rest_positive = size["n"] - len(built), size["p"] - int(model.labels.sum())
    model.elsewhere = (rest_positive + 0.5) / (rest + 2.0)
    votes = [model.vote(np.array(t, np.int64), w, k)[0] for k, (t, _, _, w) in enumerate(built)]
    judged = [(v, y) for v, y in zip(votes, model.labels.tolist()) if v is not None]
    if judged:
        model.knots, model.values = isotonic(*(np.array(v) for v in zip(*judged)))
    else:
        model.values = np.array([model.elsewhere])
    return model


class _Judge:
    """Scores chunks; equal term counts are judged once."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[float, list[int], list[float]]]:
        """Score, neighbours and cosines of every text."""
        model = self.model
        text, code, count = term_counts(data, offsets)
        known = np.isin(code, model.terms)
        text, code, count = text[known], code[known], count[known]
        bounds = np.searchsorted(text, np.arange(len(offsets)))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                out.append((model.elsewhere, [], []))
                continue
            key = code[a:b].tobytes() + count[a:b].tobytes()
            if key not in self.seen:
                if len(self.seen) > 100_000:
                    self.seen.clear()
                vote, near, cosine = model.vote(*model.vector(code[a:b], count[a:b]))
                self.seen[key] = (model.score(vote), model.ids[near].tolist(), cosine.tolist())
            out.append(self.seen[key])
        return out


_SCORES = "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>"
TOXIC = 0.5


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), neighbours and cosines (the evidence).

    A null or empty text, and one without any telling term, has no neighbours and the share of toxic rows
    among such examples as its score. Repeated rows are scored alike. Without labelled rows every score is
    0.25. An empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch, data, offsets in chunks(batches):
            score, near, cosine = zip(*judge(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(score, pa.float64()),
                    pa.array(near, pa.list_(pa.int64())),
                    pa.array(cosine, pa.list_(pa.float64())),
                ],
                names=["doc_id", "score", "neighbours", "cosines"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, _SCORES)
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose score reaches 0.5, all columns kept; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(shared.value)
        for batch, data, offsets in chunks(batches):
            yield batch.filter(pa.array([score < TOXIC for score, _, _ in judge(data, offsets)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
