"""URL filters: host-suffix and path-prefix expressions met with rules by hash; DataFrame functions only.

A rule is a host, a path and a verdict. It fits its host and all subdomains, where the url's path starts with the rule's
path. Every url is expanded into the expressions that some rule could equal (its last k host labels, for every number of
labels a rule has, with its first n path characters, for every path length a rule has). Expressions and rules meet by
an equi-join on the first 32 bits of their SHA-256, which is a short key for lists of any size; the full digest then
confirms the meeting, and precedence decides among the rules that fit.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY_DIGITS = 8
RULE_COLUMNS = "host string, path string, verdict string"


def rules(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A rule table (host, path, verdict) of given rows; a long list is better kept as a table."""
    structs = [F.struct(*map(F.lit, row)) for row in rows]
    table = F.array(*structs) if structs else F.array()
    return spark.range(1).select(F.inline(table.cast(f"array<struct<{RULE_COLUMNS.replace(' string', ':string')}>>")))


def _lowered(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of every row.

    The host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
    goes on up to ``?``, ``#`` or the end. A url that is null or has no ``://`` has neither (both empty).
    """
    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.substr("url", F.instr("url", "://") + 3), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index("rest", "/", 1)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), rest.alias("rest")).select(
        "page_id", _lowered(host).alias("host"), F.substr("rest", F.char_length(host) + 1).alias("path")
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def _key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("bigint")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, "[.]"))


def _keyed(table: DataFrame) -> DataFrame:
    """rule, rule_verdict, rank (length of the rule, then of its host), rule_digest, key, k labels, n path characters.

    Rows without a host, a path or a verdict are no rules. An empty path fits every path. Of an allow and a block rule
    with the same host and path the block rule counts.
    """
    host, path = _lowered(F.col("host")), F.col("path")
    known = table.select(host.alias("host"), path, "verdict").filter("host <> '' and path is not null")
    return (
        known.filter("verdict in ('allow', 'block')")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(
            F.concat("host", "path").alias("rule"),
            "rule_verdict",
            F.struct(F.char_length("host") + F.char_length("path"), F.char_length("host")).alias("rank"),
            _digest(F.col("host"), path).alias("rule_digest"),
            _labels(F.col("host")).alias("k"),
            F.char_length("path").alias("n"),
        )
        .withColumn("key", _key(F.col("rule_digest")))
    )


def _expressions(shapes: list[tuple[int, int]]) -> Column:
    """Digests of the expressions of (host, path) with these numbers of host labels and path characters."""
    if not shapes:
        return F.array().cast("array<string>")
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in shapes))
    fitting = F.filter(every, lambda s: (s["k"] <= F.col("host_labels")) & (s["n"] <= F.col("path_length")))

    def digest(shape: Column) -> Column:
        suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -shape["k"])
        return _digest(suffix, F.substr("path", F.lit(1), shape["n"]))

    return F.transform(fitting, digest)


def judged(pages: DataFrame, table: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    The longest rule that fits (host and path together, then the longer host) decides; without one, rule is null and the
    verdict is ``default``. Every row is judged on its own: a page_id may be null or repeat, and no rules are no error.

    Spark broadcasts the rule table if its measured size allows, and else shuffles by the short keys and splits hot ones;
    behind a broadcast the expressions of a url are reduced to one row before they are shuffled.
    """
    keyed = _keyed(table)
    # At most as many as different label counts times different path lengths, whatever the number of rules.
    shapes = sorted((row["k"], row["n"]) for row in keyed.select("k", "n").distinct().collect())
    urls = parts(pages).withColumns(
        {
            "row": F.monotonically_increasing_id(),
            "host_labels": _labels(F.col("host")),
            "path_length": F.char_length("path"),
        }
    )
    expanded = urls.select("row", "page_id", "host", "path", F.explode_outer(_expressions(shapes)).alias("digest"))
    expanded = expanded.withColumn("key", _key(F.col("digest")))
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct("rank", "rule", "rule_verdict"))
    met = expanded.join(keyed.drop("k", "n"), "key", "left").withColumn("fits", confirmed)
    best = met.groupBy("row").agg(
        F.first("page_id").alias("page_id"),
        F.first("host").alias("host"),
        F.first("path").alias("path"),
        F.max("fits").alias("best"),
    )
    verdict = F.coalesce("best.rule_verdict", F.lit(default))
    return best.select("page_id", "host", "path", "best.rule", verdict.alias("verdict"))
