"""Labelled rows: the hold-out rule, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLD_OUT = 5
_SCALE = 1 << 30


def held_out(doc_id: Column) -> Column:
    """Every fifth row, by the CRC-32 of its id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HOLD_OUT == 0


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` rows (all, if there are no more), by a hash of doc_id."""
    count = rows.count()
    share = min(limit / count, 1) if count else 1
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_SCALE)) < int(share * _SCALE))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label (0 or 1) of the rows labels may be learned from; a doc_id with several labels counts as 1
    if one of them is. Null ids and null labels are left out."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))
