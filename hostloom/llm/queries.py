"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm import (
    centroids,
    decontamination,
    neardup,
    negatives,
    oracle,
    packing,
    phrases,
    quality,
    sharding,
    token_counts,
    token_files,
    toxicity,
    url_rules,
    winnowing,
)
from hostloom.llm.text import prepared
from hostloom.session import stored

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_registry: dict[str, Query] = {}


def _query(function: Query) -> Query:
    @wraps(function)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return function(spark, sf_dir)

    _registry[function.__name__] = shipped
    return shipped


def queries() -> dict[str, Query]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_files(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"), TOKENIZER)


@_query
def op2_packing(spark, sf_dir):
    return packing.digests(packing.packed(packing.pieces(_table(spark, sf_dir, "documents"), TOKENIZER)))


@_query
def op3_decontamination(spark, sf_dir):
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query
def op5_repeated_phrases(spark, sf_dir):
    return phrases.digests(phrases.deduplicated(_table(spark, sf_dir, "documents")))


@_query
def op6_quality(spark, sf_dir):
    table = quality.featured(_table(spark, sf_dir, "documents"))
    return quality.scored_features(table, quality.fit_features(table, _table(spark, sf_dir, "labels")))


@_query
def op7_minhash(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op8_token_counts(spark, sf_dir):
    return token_counts.context_limits(token_counts.length_histogram(_table(spark, sf_dir, "documents"), TOKENIZER))


@_query
def op9_virtual_slots(spark, sf_dir):
    rows = sharding.records(_table(spark, sf_dir, "documents"))
    slot_map = stored(sharding.first_map(sharding.slot_bytes(rows)), "slot-map-1")
    return sharding.assigned(rows, slot_map).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


@_query
def op10_winnowing(spark, sf_dir):
    return winnowing.edited_and_next(_table(spark, sf_dir, "documents"))


@_query
def op11_ptolemaic_clusters(spark, sf_dir):
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


@_query
def op12_packed_negatives(spark, sf_dir):
    return negatives.hard_negatives(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


@_query
def op13_url_rules(spark, sf_dir):
    return url_rules.judged(_table(spark, sf_dir, "pages"), url_rules.rules(spark, URL_RULES))


@_query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
