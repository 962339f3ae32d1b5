"""Exact length histogram: documents by encoded length, and what its suffix sums answer.

Encoding gives one number per document; all else is an aggregate over the histogram, which has one row per
length that occurs, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.text import chunks
from hostloom.llm.tokens import encoder


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per document with its number of ids (n_tokens); a null text counts as empty and has 0."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for _, data, offsets in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(encode.counts(data, offsets))], names=["n_tokens"])

    return docs.select("text").mapInArrow(lengths, "n_tokens bigint")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, n_docs: how many documents have exactly that length. An empty table gives no row."""
    return token_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    docs_within / tokens_within (documents not longer), docs_beyond (longer ones, from the suffix sum),
    kept_tokens (all documents cut to the limit), lost_tokens, share_within (the quantile of this length).

    A limit between two lengths answers as ``answers`` does. The window runs over one row per length.
    """
    below = Window.orderBy("n_tokens")
    beyond = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = histogram.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.sum("n_docs").over(below).alias("docs_within"),
        F.sum(tokens).over(below).alias("tokens_within"),
        F.coalesce(F.sum("n_docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum(tokens).over(beyond), F.lit(0)).alias("tokens_beyond"),
    )
    cut = F.col("context_limit") * F.col("docs_beyond")
    return sums.select(
        "context_limit",
        "n_docs",
        "docs_within",
        "tokens_within",
        "docs_beyond",
        (F.col("tokens_within") + cut).alias("kept_tokens"),
        (F.col("tokens_beyond") - cut).alias("lost_tokens"),
        (F.col("docs_within") / (F.col("docs_within") + F.col("docs_beyond"))).alias("share_within"),
    )


def answers(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """docs_within, kept_tokens and lost_tokens for any limits: one pass over the histogram for all of them."""
    each = histogram.withColumn("context_limit", F.explode(F.array(*[F.lit(int(v)) for v in limits])))
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return each.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") <= F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_within"),
        F.sum(kept).alias("kept_tokens"),
        F.sum(F.col("n_tokens") * F.col("n_docs") - kept).alias("lost_tokens"),
    )


def quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least the given share of documents does not exceed."""
    each = limits.withColumn("share", F.explode(F.array(*[F.lit(float(v)) for v in shares])))
    reached = each.filter(F.col("share_within") >= F.col("share"))
    return reached.groupBy("share").agg(F.min("context_limit").alias("n_tokens"))
