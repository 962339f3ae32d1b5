"""Training sets: class weights, stratified split and folds, slice rows by host split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Number of leading hexadecimal digits of the hash that form a rank bucket (4,096 buckets).
_BUCKET_DIGITS = 3


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k n_c) per class: (label, n, weight)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # The window sees one row per class.
    whole = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_weights(df: DataFrame, label: str, weights: DataFrame | None = None) -> DataFrame:
    """Adds each row's class weight as ``weight``; pass ``weights`` to use those of another frame.

    A class that ``weights`` does not list has weight 1. A null label is an error.
    """
    if weights is None:
        weights = class_weights(df, label)
    present = F.when(F.col(label).isNull(), F.raise_error(F.lit(f"null in {label}")).cast("double"))
    joined = df.join(weights.select(label, F.col("weight").alias("_weight")), label, "left")
    return joined.withColumn("weight", present.otherwise(F.coalesce("_weight", F.lit(1.0)))).drop("_weight")


def stratified_rank(df: DataFrame, label: str, seed: int = 0, host: str = "ip") -> DataFrame:
    """Adds ``rank`` (1-based, in hash order within the class) and ``class_size``.

    The order is the md5 of host and seed: reproducible on any cluster and independent of partitioning.
    Ranking a whole class in one window would put it into one task, so rows are ranked inside hash
    buckets, whose sizes then give each bucket its offset. The order of (bucket, hash) is the order of
    the hash, so the result is exactly the rank within the class. ``df`` is read twice (sizes and rows):
    store it first if it is costly to compute.
    """
    digest = F.md5(F.concat(F.col(host), F.lit(f"|{seed}")).cast("binary"))
    keyed = df.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, _BUCKET_DIGITS))
    sizes = keyed.groupBy(label, "bucket").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(label)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        label,
        "bucket",
        (F.sum("size").over(before) - F.col("size")).alias("offset"),
        F.sum("size").over(whole).alias("class_size"),
    )
    inside = Window.partitionBy(label, "bucket").orderBy("digest", host)
    ranked = keyed.withColumn("place", F.row_number().over(inside))
    joined = ranked.join(offsets, [label, "bucket"])
    return joined.withColumn("rank", F.col("offset") + F.col("place")).drop("digest", "bucket", "offset", "place")


def stratified_split(df: DataFrame, label: str, test_per_mille: int = 200, seed: int = 0) -> DataFrame:
    """Adds ``part``: the first ``test_per_mille``/1000 of each class (rounded up) are ``test``."""
    ranked = stratified_rank(df, label, seed)
    limit = F.ceil(F.col("class_size") * test_per_mille / 1000)
    part = F.when(F.col("rank") <= limit, "test").otherwise("train")
    return ranked.withColumn("part", part).drop("rank", "class_size")


def stratified_folds(df: DataFrame, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold`` (0-based), dealing each class round-robin over the folds."""
    ranked = stratified_rank(df, label, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "class_size")


def slice_train_test(slice_rows: DataFrame, split: DataFrame, column: str = "part") -> DataFrame:
    """Slice rows of the hosts in ``split``, each carrying its host's ``part`` (or ``fold``).

    A host is wholly in one part, with all its slices; hosts without a part drop out. Both sides are
    host tables, so the join has no hint.
    """
    return slice_rows.join(split.select("ip", column), "ip")


def class_comparison(slice_features: DataFrame, slice_labels: DataFrame, class_a: int, class_b: int) -> DataFrame:
    """Slice feature rows of two classes with their ``label``."""
    chosen = slice_labels.filter(F.col("label").isin(class_a, class_b)).select("slice", "ip", "label")
    return slice_features.join(chosen, ["slice", "ip"])


def _logarithms(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, feature, x): logarithms to nine decimals of the values that have a finite one."""
    wide = df.select(label, *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot([label], list(features), "feature", "value")
    return long.filter((F.col("value") > 0) & (F.col("value") < float("inf"))).select(
        label, "feature", F.round(F.log10("value"), 9).alias("x")
    )


def automatic_bins(df: DataFrame, features: list[str], label: str = "label", accuracy: int = 10_000) -> DataFrame:
    """One row per feature with a positive value: (feature, low, width, bins) over log10 of the values of all classes.

    The width is the smaller one of two rules: twice the interquartile range over the cube root of the number of
    values (not used where the range is 0), and the whole span over log2 of the number, plus 1; it is then narrowed so that whole
    bins fill the span. Quartiles come from mergeable sketches: exact up to ``accuracy`` / 2 values a feature, beyond that
    within a share of 1 / ``accuracy`` of the ranks. A feature with one value has one bin of width 1 around it.
    """
    spread = _logarithms(df, features, label).groupBy("feature").agg(
        F.count("*").alias("n"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.percentile_approx("x", [0.25, 0.75], accuracy).alias("quartiles"),
    )
    span = F.col("most") - F.col("least")
    by_count = span / (F.log2("n") + 1)
    by_quartiles = 2 * (F.get("quartiles", F.lit(1)) - F.get("quartiles", F.lit(0))) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.when(by_quartiles > 0, F.least(by_quartiles, by_count)).otherwise(by_count)
    # A billionth less, so that the last digit of a quotient does not add a bin.
    bins = F.when(span > 0, F.ceil(span / width - 1e-9)).otherwise(F.lit(1)).cast("bigint")
    low = F.when(span > 0, F.col("least")).otherwise(F.col("least") - 0.5)
    return spread.select("feature", low.alias("low"), F.when(span > 0, span / bins).otherwise(F.lit(1.0)).alias("width"), bins.alias("bins"))


def automatic_density(df: DataFrame, features: list[str], label: str = "label", accuracy: int = 10_000) -> DataFrame:
    """``feature_density`` over the bins of ``automatic_bins``: (feature, label, bin, left, width, n, density).

    Classes share a feature's bins and are normalised each by itself; ``left`` is the lower edge in log10. The last bin holds
    its upper edge. ``df`` is read twice (bins and counts): store it first if it is costly to compute.
    """
    # At most one row per feature.
    bins = F.broadcast(automatic_bins(df, features, label, accuracy))
    placed = _logarithms(df, features, label).join(bins, "feature")
    number = F.floor((F.col("x") - F.col("low")) / F.col("width") + 1e-9)
    bin_ = F.least(number, F.col("bins") - 1).cast("bigint")
    counts = placed.groupBy("feature", label, bin_.alias("bin"), "low", "width").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature", label))
    left = F.col("low") + F.col("bin") * F.col("width")
    return counts.select("feature", label, "bin", left.alias("left"), "width", "n", (F.col("n") / (total * F.col("width"))).alias("density"))


def feature_density(
    df: DataFrame, features: list[str], label: str = "label", bins_per_decade: int = 10
) -> DataFrame:
    """Histogram of each feature per class over log10 bins, normalised within (feature, class).

    Values that have no logarithm are left out, also of the total. Output: (feature, label, bin, n,
    density); bin ``b`` covers ``10^(b/bins_per_decade)`` up to the next edge. A value within a billionth of a
    bin below an edge counts as on it, so that the last digits of a variance do not decide.
    """
    wide = df.select(label, *[F.col(c).cast("double").alias(c) for c in features])
    long = wide.unpivot([label], list(features), "feature", "value").filter(F.col("value") > 0)
    bin_ = F.floor(F.log10("value") * bins_per_decade + 1e-9).cast("bigint")
    counts = long.groupBy("feature", label, bin_.alias("bin")).agg(F.count("*").alias("n"))
    # The window sees one row per bin.
    total = F.sum("n").over(Window.partitionBy("feature", label))
    return counts.withColumn("density", F.col("n") / (total * F.lit(1.0 / bins_per_decade)))
