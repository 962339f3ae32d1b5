"""Connected components of an edge table by joins and groupings, for any number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostloom.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    tied = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes without an edge are not listed.

    Alternates the two steps until every edge leads to its component's smallest node. Each round is written to
    the shared folder, which cuts the lineage; chains shorten by half per round. Only a count reaches the driver.
    """
    current = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        starred = stored(_small_star(_large_star(current)), "edges")
        # Done when no smallest node is itself tied to another, and no node to two.
        ends = starred.select(F.col("b").alias("a")).distinct().join(starred, "a", "left_semi")
        doubled = starred.groupBy("a").count().filter("count > 1")
        if ends.isEmpty() and doubled.isEmpty():
            break
        current = starred
    roots = starred.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return starred.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
