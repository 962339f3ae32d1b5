"""Quality by positive-unlabelled learning.

Trusted positives are labelled training rows of good quality; the unlabelled side is the corpus itself, its labels
unseen, without the rows held out. A small network minimises the non-negative unbiased risk: with class prior p, the risk on positives counts p times, and the
risk of the unlabelled as negatives less p times that of the positives as negatives may not fall below
zero (where it does, the step is reversed). The prior is estimated from the top scores of a first fit: the
share of unlabelled rows over the share of positives above a limit is smallest where only positives are left. Scores are
posteriors: prior times the ratio of both sides' densities along the network's output, made increasing.

Texts are read once: their features, 34 numbers each, are written to the shared folder, and every later step reads
these. Networks are fitted on bounded samples; the prior and the unlabelled side's density come from all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.labelled import held_out, training_labels
from hostloom.llm.text import ASCII_LOWER, chunks, mixed, span_hashes, words
from hostloom.session import stored

MAX_POSITIVES = 8_000
MAX_UNLABELLED = 16_000
HIDDEN = 24
EPOCHS = 60
BATCH = 512
THRESHOLD = 0.3

# Byte classes: lower, upper, digit, full stop or comma, each further mark, space, line end, beyond ASCII, control.
_CLASS = np.full(256, 8, np.int64)
_CLASS[[*range(ord("a"), ord("z") + 1)]] = 0
_CLASS[[*range(ord("A"), ord("Z") + 1)]] = 1
_CLASS[[*range(ord("0"), ord("9") + 1)]] = 2
_CLASS[[ord("."), ord(",")]] = 3
_CLASS[ord(" ")] = 4
_CLASS[[ord("\n"), ord("\r")]] = 5
_CLASS[[*range(0x80, 0x100)]] = 6
_CLASS[[*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]] = 7
for _k, _mark in enumerate("!?|*%$#&@:;-_/\"'"):
    _CLASS[ord(_mark)] = 9 + _k
CLASSES = 9 + 16
FEATURES = CLASSES + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of every text of a chunk: shares of byte classes, word lengths, repetition, capitals, size."""
    count = len(offsets) - 1
    text = np.repeat(np.arange(count), np.diff(offsets))
    classes = np.bincount(text * CLASSES + _CLASS[data], minlength=count * CLASSES).reshape(count, CLASSES)
    size = np.maximum(np.diff(offsets), 1)
    lower = ASCII_LOWER[data]
    starts, ends, first = words(lower, offsets)
    number = np.diff(first)
    some = np.maximum(number, 1)
    owner = np.repeat(np.arange(count), number)
    hashes = span_hashes(lower, starts, ends)

    def per_text(values) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=count) / some

    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    new = np.ones(len(hashes), bool)
    keyed = np.sort(mixed(hashes ^ mixed(owner.astype(np.uint64))))
    new[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount(_owner_of(keyed[new], hashes, owner), minlength=count) / some
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    opening = data[starts] if len(starts) else last
    marked = (_CLASS[last] == 8) | (_CLASS[last] >= 9)
    capital = (_CLASS[opening] == 1) & (_CLASS[data[np.minimum(starts + 1, ends - 1)]] == 1)
    length = ends - starts
    lines = np.bincount(text, weights=data == 0x0A, minlength=count) + 1
    columns = [
        per_text(length) / 10,
        np.sqrt(np.maximum(per_text(length**2) - per_text(length) ** 2, 0)) / 10,
        per_text(again),
        distinct,
        distinct * np.log1p(some),
        per_text(marked),
        per_text(capital),
        np.log1p(number) / 10,
        np.log1p(number / lines) / 10,
    ]
    return np.hstack([np.sqrt(classes / size[:, None]), np.stack(columns, axis=1)]).astype(np.float32)


def _owner_of(keys: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The text of every distinct (text, word) key."""
    own = mixed(hashes ^ mixed(owner.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    return owner[order[np.searchsorted(own[order], keys)]]


class Network:
    """One hidden layer; fitted by Adam on the non-negative risk with the sigmoid loss."""

    def __init__(self, width: int, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.parts = [
            self.rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)),
            np.zeros(HIDDEN),
            self.rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            np.zeros(1),
        ]

    def outputs(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2[0]

    def _gradients(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        w1, b1, w2, _ = self.parts
        hidden = np.maximum(x @ w1 + b1, 0)
        back = (slope[:, None] * w2) * (hidden > 0)
        return [x.T @ back, back.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts]
        step = 0
        share = len(positive) / (len(positive) + len(unlabelled))
        n_positive = max(int(BATCH * share), min(len(positive), 64))
        n_unlabelled = max(BATCH - n_positive, min(len(unlabelled), 64))
        for _ in range(EPOCHS * max(1, (len(positive) + len(unlabelled)) // BATCH)):
            p = positive[self.rng.integers(0, len(positive), n_positive)]
            u = unlabelled[self.rng.integers(0, len(unlabelled), n_unlabelled)]
            x = np.vstack([p, u])
            chance = 1 / (1 + np.exp(-np.clip(self.outputs(x), -30, 30)))  # loss as a negative; as a positive 1 - chance
            slope = chance * (1 - chance)
            of_p, of_u = slice(0, len(p)), slice(len(p), None)
            negative_risk = chance[of_u].mean() - prior * chance[of_p].mean()
            pull = np.zeros(len(x))
            if negative_risk >= 0:
                pull[of_p] -= prior * slope[of_p] / len(p)
                sign = 1.0
            else:
                sign = -1.0
            pull[of_u] += sign * slope[of_u] / len(u)
            pull[of_p] -= sign * prior * slope[of_p] / len(p)
            step += 1
            for part, moment, gradient in zip(self.parts, moments, self._gradients(x, pull)):
                gradient = gradient + 1e-4 * part
                moment[0] += 0.1 * (gradient - moment[0])
                moment[1] += 0.001 * (gradient**2 - moment[1])
                part -= 0.003 * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        return self


def prior_limits(positive: np.ndarray) -> np.ndarray:
    """Rising outputs above which both sides are counted."""
    return np.unique(np.quantile(positive, np.linspace(0.02, 0.98, 97)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from outputs on rows not used to fit."""
    return prior_from_counts(positive, binned(unlabelled, prior_limits(positive)))


def binned(outputs: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many outputs lie below the first edge, between edges (from an edge on), and at or above the last."""
    return np.bincount(np.searchsorted(edges, outputs, "right"), minlength=len(edges) + 1)


def prior_from_counts(positive: np.ndarray, counts: np.ndarray) -> float:
    """As ``estimated_prior``; ``counts`` are the unlabelled rows between ``prior_limits(positive)``."""
    p = np.array([(positive >= c).mean() for c in prior_limits(positive)])
    u = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(counts.sum()))
    best = np.argmin((u + error) / p)  # the smallest upper confidence limit
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    network: Network | None
    prior: float
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(x), self.prior)
        out = self.network.outputs((x - self.mean) / self.scale)
        return np.interp(out, self.knots, self.values)


def posterior_edges(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    return np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, 41)))


def posteriors(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of an increasing posterior along the outputs."""
    edges = posterior_edges(positive, unlabelled)
    return posteriors_from_counts(edges, positive, binned(unlabelled, edges[1:-1]), prior)


def posteriors_from_counts(
    edges: np.ndarray, positive: np.ndarray, counts: np.ndarray, prior: float
) -> tuple[np.ndarray, np.ndarray]:
    """As ``posteriors``; ``counts`` are the unlabelled rows between the inner edges, what lies beyond the outer ones
    included."""
    if len(edges) < 2:
        return edges[:1], np.array([prior])
    p = binned(positive, edges[1:-1]) + 0.5
    u = counts + 1.0
    ratio = np.clip(prior * (p / p.sum()) / (u / u.sum()), 0, 1)
    # Pool adjacent violators, weighted by the unlabelled rows.
    blocks: list[list[float]] = []
    for value, weight in zip(ratio, u):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    values = np.concatenate([[s / w] * int(n) for s, w, n in blocks])
    return (edges[:-1] + edges[1:]) / 2, values


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and features (float bytes) of every row, written once and read from the shared folder.

    A null text counts as empty. Other columns do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            body = [row.tobytes() for row in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(body, pa.binary())], names=["doc_id", "row"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id bigint, row binary"), "quality-features")


def _matrix(rows: pa.Array | list[bytes]) -> np.ndarray:
    rows = rows.to_pylist() if isinstance(rows, pa.Array) else rows
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, FEATURES).astype(float)


def _place() -> Column:
    """Place of a row between 0 and 1, by which samples and halves are taken."""
    return F.pmod(F.xxhash64("doc_id", "row", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _drawn(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Features and places of about ``limit`` rows (all, if there are no more), and the place up to which they go.

    Equal rows have one place and are drawn once, so the sample is bounded however often a row or a doc_id repeats.
    """
    count = rows.count()
    share = min(limit / count, 1.0) if count else 1.0
    picked = rows.withColumn("place", _place()).filter(F.col("place") < share).distinct().collect()
    picked = sorted((r["place"], r["doc_id"] is None, r["doc_id"] or 0, bytes(r["row"])) for r in picked)
    return _matrix([r[3] for r in picked]), np.array([r[0] for r in picked]), share


def _counted(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, network: Network, edges: np.ndarray) -> np.ndarray:
    """``binned`` outputs of all rows: counted per batch, added up by Spark."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, scale, network, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, network, edges = shared.value
        total = np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            total += binned(network.outputs((_matrix(batch.column("row")) - mean) / scale), edges)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["bin", "n"])

    counts = rows.select("row").mapInArrow(run, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    result = np.zeros(len(edges) + 1, np.int64)
    for r in counts.collect():
        result[r["bin"]] = r["n"]
    return result


def fit(docs: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED) -> Model:
    """``fit_features`` of the documents' features."""
    return fit_features(featured(docs), labels, positives, unlabelled)


def fit_features(
    table: DataFrame, labels: DataFrame, positives: int = MAX_POSITIVES, unlabelled: int = MAX_UNLABELLED
) -> Model:
    """Learn from about ``positives`` trusted rows and about ``unlabelled`` rows of the corpus.

    ``table`` is ``featured``; ``labels`` has doc_id and quality. Labels of held-out rows are not looked at and their texts
    are not learned from. Any other row may be drawn as unlabelled, whether it has a label or not, so a corpus in which
    every row is labelled is no special case. The two bounds hold for the rows the networks are fitted on. The prior is counted
    over all rows the first network has not seen, the posterior's density over all rows. With fewer than four rows on
    either side nothing is learned and every score is 0.5.
    """
    trusted = training_labels(labels, "quality").filter("label = 1").select("doc_id")
    corpus = table.filter(~held_out(F.col("doc_id")))
    positive, _, _ = _drawn(corpus.join(trusted, "doc_id", "left_semi"), positives)
    sample, places, share = _drawn(corpus, unlabelled)
    if len(positive) < 4 or len(sample) < 4:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, 0.5, np.zeros(1), np.zeros(1))
    both = np.vstack([positive, sample])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (sample - mean) / scale
    # A first fit on one half with an even prior, whose outputs on all other rows give the estimate.
    half = places < share / 2
    if half.any() and not half.all():
        first, unseen = Network(FEATURES).fit(p[::2], u[half], 0.5), corpus.filter(_place() >= share / 2)
    else:
        first, unseen = Network(FEATURES).fit(p[::2], u, 0.5), corpus
    outputs = first.outputs(p[1::2])
    prior = prior_from_counts(outputs, _counted(unseen, mean, scale, first, prior_limits(outputs)))
    network = Network(FEATURES, 1).fit(p, u, prior)
    outputs = network.outputs(p)
    edges = posterior_edges(outputs, network.outputs(u))
    counts = _counted(table, mean, scale, network, edges[1:-1])
    return Model(mean, scale, network, prior, *posteriors_from_counts(edges, outputs, counts, prior))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``scored_features`` of the documents' features. A null text counts as empty and is scored by its shape as any other."""
    return scored_features(featured(docs), model)


def scored_features(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3), one row per row of ``table``.

    Repeated rows are scored alike. An empty table gives no row.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = model.score(_matrix(batch.column("row")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    rows = table.select("doc_id", "row").mapInArrow(run, "doc_id bigint, score double")
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
