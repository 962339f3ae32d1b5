"""Scans: session CSVs, session Parquet, address lists, host inventory, stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostloom.functions.ranges import MAX_RANGES, IpRanges, compiled
from hostloom.schema import LABEL_SCHEMA, SESSION_CSV_NAMES, SESSION_SCHEMA


def read_sessions_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Union of daily session CSVs (files or folders) with a header row.

    Columns are found by header name, so each path may order them differently and carry further columns;
    the files of one folder share one header, and a file with another one is an error. The CSV reader parses only
    the columns a query needs. Numbers may be written as floats: "443.0" is 443, a fraction is cut off, and
    what is no number ("NaN", "") becomes null.
    """

    def day(path: str) -> DataFrame:
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        columns = []
        for field in SESSION_SCHEMA:
            text = F.col(f"`{SESSION_CSV_NAMES[field.name]}`")
            if field.dataType.simpleString() == "bigint":
                # A plain integer keeps all its digits; only float notation goes through double.
                text = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
            columns.append(text.alias(field.name))
        return raw.select(columns)

    return reduce(DataFrame.unionByName, (day(p) for p in paths))


def read_sessions(spark: SparkSession, *paths: str) -> DataFrame:
    """Sessions stored as Parquet in the column contract."""
    return spark.read.schema(SESSION_SCHEMA).parquet(*paths)


def read_public_ips(spark: SparkSession, path: str) -> DataFrame:
    """One-column list of public addresses (header ``source.ip``) as ``ip``."""
    return spark.read.option("header", True).csv(path).select(F.col("`source.ip`").alias("ip"))


def read_host_labels(spark: SparkSession, path: str) -> DataFrame:
    """Host inventory CSV; columns are found by header name and further label columns are kept as text."""
    raw = spark.read.option("header", True).csv(path)
    typed = {f.name: F.col(f.name).try_cast(f.dataType.simpleString()) for f in LABEL_SCHEMA}
    codes = {c: F.col(c).try_cast("bigint") for c in ("red_vs_blue", "facility_class") if c in raw.columns}
    return raw.withColumns(typed | codes)


def range_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the range table below ``path``, rising."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = (status.getPath().getName() for status in files.listStatus(root))
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def read_ranges(spark: SparkSession, path: str, version: int | None = None) -> IpRanges:
    """A version (the last, if none is named) of a range table written by ``writers.write_ranges``.

    A registry's size bounds the table; beyond ``MAX_RANGES`` rows reading is an error.
    """
    known = range_versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"no version {version or ''} of the ranges in {path}")
    folder = f"{path}/version={known[-1] if version is None else version}"
    rows = spark.read.option("header", True).schema("cidr string, is_global boolean").csv(folder)
    return compiled((r["cidr"], r["is_global"]) for r in rows.limit(MAX_RANGES + 1).collect())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored intermediate table."""
    return spark.read.parquet(path)
