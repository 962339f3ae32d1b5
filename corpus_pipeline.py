"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes every stage's rows to the shared folder
and reads them again as the next stage's documents, so a lost executor costs a part of one stage. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.llm import decontamination, neardup, packing, phrases, toxicity
from hostloom.llm.queries import TOKENIZER
from hostloom.llm.text import prepared
from hostloom.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# The stages encode and align texts, which SQL cannot express; tests compare with a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose nearest labelled examples call them toxic go."""
    prepared(spark)
    docs = docs.select(*COLUMNS)
    return toxicity.accepted(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest doc_id stays."""
    prepared(spark)
    docs = docs.select(*COLUMNS)
    dropped = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeated_phrases(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that earlier documents have go; a document that loses all its words goes too."""
    prepared(spark)
    rows = phrases.deduplicated(docs.select(*COLUMNS))
    rows = rows.filter("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    return rows.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        "rest.lang",
        "rest.source",
        F.when(cut, F.char_length("kept_text").cast("bigint")).otherwise(F.col("rest.n_chars")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a stretch of a benchmark item go."""
    prepared(spark)
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place among sequences of 1024 ids."""
    prepared(spark)
    return packing.digests(packing.packed(packing.pieces(docs, TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_phrases),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
