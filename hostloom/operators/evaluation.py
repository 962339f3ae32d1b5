"""Evaluation of predictions.

Frames carry ``ip``, ``slice``, ``slice_no``, ``fold``, a true class and one or two predicted ones.
Each operator first counts (true, predicted) pairs, which leaves at most classes^2 rows per group, and
works on those; nothing about single predictions is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.functions.numbers import ratio
from hostloom.schema import ROLE_NAMES

CLASSES = tuple(ROLE_NAMES)


def pair_counts(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame,
    true: str,
    pred: str,
    classes: Sequence[int] = CLASSES,
    normalize: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per class with columns ``pred_<class>``: counts, or shares of the row.

    A class that is never true has a row of zeros. A code outside ``classes``, or null, is an error.
    """
    counts = pair_counts(df, true, pred, by)
    known = F.col("true").isin(*classes) & F.col("pred").isin(*classes)
    message = F.concat_ws(" ", F.lit("class outside the matrix:"), "true", "pred")
    checked = F.when(F.coalesce(known, F.lit(False)), F.col("n")).otherwise(F.raise_error(message).cast("bigint"))
    counts = counts.withColumn("n", checked)
    # Zero rows for every class; one row per group and class.
    groups = counts.groupBy(*by).agg(F.count("*").alias("pairs"))
    zeros = groups.select(*by, F.explode(F.array(*[F.lit(c).cast("bigint") for c in classes])).alias("true"))
    zeros = zeros.withColumns({"pred": F.col("true"), "n": F.lit(0).cast("bigint")})
    counts = counts.withColumns({c: F.col(c).cast("bigint") for c in ("true", "pred")}).unionByName(zeros)
    cells = [F.coalesce(F.sum(F.when(F.col("pred") == c, F.col("n"))), F.lit(0)) for c in classes]
    if normalize:
        cells = [ratio(cell, F.sum("n")) for cell in cells]
    return counts.groupBy(*by, "true").agg(*[cell.alias(f"pred_{c}") for c, cell in zip(classes, cells)])


def class_scores(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or predicted somewhere."""
    return scores_of_counts(pair_counts(df, true, pred, by), by)


def scores_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``class_scores`` from counts of (true, pred) pairs."""
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("true") == F.col("pred"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("true").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("hits")),
    )
    sums = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return sums.select(
        *by,
        "class",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
        "hits",
    )


def classification_report(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class plus ``accuracy``, ``macro avg`` and ``weighted avg``.

    All parts share the pair counts: the predictions are aggregated once and the exchange is reused.
    """
    scores = class_scores(df, true, pred, by)
    per_class = scores.select(*by, F.col("class").cast("string").alias("label"), "precision", "recall", "f1", "support")
    accuracy = ratio(F.sum("hits"), F.sum("support"))
    total = F.sum("support")
    measures = ("precision", "recall", "f1")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(m) for m in measures], F.col("support")),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{m}").alias(m) for m in measures], F.col("support")),
        F.struct(
            F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{m}").alias(m) for m in measures], F.col("support")
        ),
    )
    means = (
        scores.groupBy(*by)
        .agg(
            accuracy.alias("accuracy"),
            total.alias("support"),
            *[F.avg(m).alias(f"macro_{m}") for m in measures],
            *[ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures],
        )
        .select(*by, F.inline(rows))
    )
    return per_class.unionByName(means)


def macro_f1(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the per-class F1."""
    return macro_f1_of_counts(pair_counts(df, true, pred, by), by)


def macro_f1_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores_of_counts(counts, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def misclassified(df: DataFrame, true: str, pred: str, label: int | None = None) -> DataFrame:
    """Wrong predictions, optionally of one true class."""
    wrong = df.filter(F.col(true) != F.col(pred))
    return wrong if label is None else wrong.filter(F.col(true) == label)


def mismatches_by_host(df: DataFrame, true: str, pred: str) -> DataFrame:
    return misclassified(df, true, pred).groupBy("ip").agg(F.count("*").alias("n"))


def confused_hosts(df: DataFrame, true: str, pred: str, label: int, predicted: int) -> DataFrame:
    """Distinct hosts in one confusion cell."""
    return df.filter((F.col(true) == label) & (F.col(pred) == predicted)).select("ip").distinct()


def repeat_hosts(df: DataFrame) -> DataFrame:
    """Predictions per host; ``repeated`` is false where there is exactly one."""
    counts = df.groupBy("ip").agg(F.count("*").alias("n"))
    return counts.withColumn("repeated", F.col("n") > 1)


def merged_predictions(df: DataFrame, pred: str, majority: bool = False) -> DataFrame:
    """One label per host: its only one, otherwise the second most frequent (lowest code on ties).

    ``majority`` takes the most frequent label instead.
    """
    counts = df.groupBy("ip", pred).agg(F.count("*").alias("n"))
    # At most one row per class and host meets here.
    order = Window.partitionBy("ip").orderBy(F.desc("n"), pred)
    ranked = counts.withColumn("place", F.row_number().over(order))
    pick = F.when(F.col("place") <= (1 if majority else 2), F.struct("place", F.col(pred).alias("pred")))
    return ranked.groupBy("ip").agg(F.max(pick)["pred"].alias("pred"))


def merged_confusion(
    df: DataFrame, pred: str, roles: DataFrame, role: str = "red_vs_blue", classes: Sequence[int] = CLASSES
) -> DataFrame:
    """Row-normalised confusion of the merged per-host prediction against the host's role."""
    scored = merged_predictions(df, pred).join(roles.select("ip", role), "ip")
    return confusion_matrix(scored, role, "pred", classes, normalize=True)


def agreement_confusion(
    df: DataFrame, true: str, pred_a: str, pred_b: str, classes: Sequence[int] = CLASSES
) -> DataFrame:
    """Confusion where two models say the same."""
    return confusion_matrix(df.filter(F.col(pred_a) == F.col(pred_b)), true, pred_a, classes)


def _correct(df: DataFrame, true: str, pred: str, above: int) -> DataFrame:
    hit = F.when(F.col(true) == F.col(pred), 1).otherwise(0)
    return df.filter(F.col(true) > above).withColumn("correct", hit)


def accuracy_by_slice(df: DataFrame, true: str, pred: str, above: int = 1) -> DataFrame:
    """Accuracy per slice over the classes beyond ``above``, slices in time order."""
    by_slice = _correct(df, true, pred, above).groupBy("slice", "slice_no").agg(F.avg("correct").alias("accuracy"))
    return by_slice.orderBy("slice_no")


def accuracy_fold_matrix(df: DataFrame, true: str, pred: str, folds: Sequence[int], above: int = 1) -> DataFrame:
    """Slices in time order x folds: columns ``preds<fold>`` and ``order``."""
    hits = _correct(df, true, pred, above)
    cells = [F.avg(F.when(F.col("fold") == f, F.col("correct"))).alias(f"preds{f}") for f in folds]
    matrix = hits.groupBy("slice", F.col("slice_no").alias("order")).agg(*cells)
    return matrix.orderBy("order")


def accuracy_melt(matrix: DataFrame) -> DataFrame:
    """Long form of the fold matrix: (order, variable, value)."""
    folds = [c for c in matrix.columns if c.startswith("preds")]
    return matrix.unpivot(["order"], folds, "variable", "value")


def accuracy_over_time(df: DataFrame, true: str, pred: str, above: int = 1) -> DataFrame:
    """Mean and sample deviation over folds of the accuracy in each slice."""
    per_fold = _correct(df, true, pred, above).groupBy("slice_no", "fold").agg(F.avg("correct").alias("accuracy"))
    spread = per_fold.groupBy("slice_no").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("std_accuracy")
    )
    return spread.orderBy("slice_no")


def _poisson(*parts) -> Column:
    """A Poisson(1) number from the md5 of the parts: how many of the distribution's steps lie below a uniform one."""
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32
    total, step, steps = 0.0, exp(-1), []
    for k in range(1, 14):
        total, step = total + step, step / k
        steps.append((uniform >= total).cast("int"))
    return sum(steps[1:], steps[0])


def accuracy_band(
    df: DataFrame, true: str, pred: str, above: int = 1, replicates: int = 1000, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Mean over folds of the accuracy in each slice, with the limits of a bootstrap interval: (slice_no, mean_accuracy,
    low, high).

    Each replicate weighs the folds by Poisson numbers hashed from (seed, slice, fold, replicate), so limits do not depend on
    partitioning. Replicates that draw no fold are left out.
    """
    per_fold = _correct(df, true, pred, above).groupBy("slice_no", "fold").agg(F.avg("correct").alias("accuracy"))
    mean = per_fold.groupBy("slice_no").agg(F.avg("accuracy").alias("mean_accuracy"))
    drawn = per_fold.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("weight", _poisson(F.lit(seed), "slice_no", "fold", "replicate"))
    means = drawn.groupBy("slice_no", "replicate").agg(
        F.sum(F.col("weight") * F.col("accuracy")).alias("sum"), F.sum("weight").alias("weight")
    )
    means = means.filter("weight > 0").withColumn("mean", F.col("sum") / F.col("weight"))
    tail = (1 - level) / 2
    limits = means.groupBy("slice_no").agg(
        F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high")
    )
    return mean.join(limits, "slice_no").orderBy("slice_no")
