"""Sinks: slice store, label CSV, fold predictions, score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.schema import SESSION_CSV_NAMES


def write_slices(df: DataFrame, path: str) -> None:
    """One folder per slice, so that a reader of one slice touches only its files.

    Rows are rebalanced by slice: adaptive execution splits a large slice over tasks and lets one task write
    several small ones, by their measured sizes.
    """
    df.hint("rebalance", "slice").write.partitionBy("slice").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Label, score and accuracy tables: CSV with header."""
    df.write.option("header", True).csv(path)


def write_ranges(ranges: DataFrame, path: str, version: int) -> None:
    """A version of a range table (cidr, is_global) as CSV: ``<path>/version=<n>``. A version is never overwritten."""
    ranges.select("cidr", "is_global").write.option("header", True).csv(f"{path}/version={version}")


def write_sessions_csv(df: DataFrame, path: str) -> None:
    """Sessions in the CSV layout the reader takes: dotted header names and float ports."""
    columns = []
    for name, header in SESSION_CSV_NAMES.items():
        value = F.col(name).cast("double") if name.endswith("_port") else F.col(name)
        columns.append(value.alias(header))
    df.select(columns).write.option("header", True).csv(path)


def write_fold_predictions(df: DataFrame, path: str) -> None:
    """Labels and predictions per fold and part, without header: ``fold=<n>/part=<train|test>/*.csv``."""
    df.write.partitionBy("fold", "part").csv(path)
