"""Tree models: fit, cross-validate, compare, project. Trees and forests are MLlib's, boosting is ``boosting``'s.

Inputs are host-sized tables. They are written to the shared folder once (``session.stored``) before
any model loop, so that no fit re-runs the feature plan. Independent fits run side by side; each writes its
predictions to the shared folder and lets its model go, so neither models nor plans pile up in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.operators import boosting, forests
from hostloom.operators.dataset import class_weights, with_weights
from hostloom.operators.depths import predict_depths, predict_nodes
from hostloom.operators.evaluation import macro_f1_of_counts, pair_counts
from hostloom.schema import FEATURE_GROUPS, FEATURES
from hostloom.session import stored

MAX_DEPTH = 30  # MLlib's limit; stands for unlimited depth of its kinds
# The depth grid; None is unlimited.
DEPTH_GRID = (1, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, None)
KINDS = ("decision_tree", "random_forest", "boosted_trees")


@dataclass(frozen=True)
class Trees:
    """Model settings."""

    kind: str = "boosted_trees"
    depth: int | None = 6
    iterations: int = 100
    trees: int = 100
    weighted: bool = True
    seed: int = 0

    @property
    def is_boosted(self) -> bool:
        return self.kind == "boosted_trees"

    @property
    def fitted_depth(self) -> int | None:
        """Boosted trees have any depth. For the other kinds unlimited depth is MLlib's limit, and more is an error."""
        if self.is_boosted:
            return self.depth
        if self.depth is not None and self.depth > MAX_DEPTH:
            raise ValueError(f"depth {self.depth}: trees have at most {MAX_DEPTH} levels")
        return MAX_DEPTH if self.depth is None else self.depth

    def estimator(self):
        """MLlib's estimator; boosted models come from ``boosted_nodes``."""
        depth = self.fitted_depth
        common = {"labelCol": "y", "featuresCol": "features", "maxDepth": depth, "seed": self.seed}
        weight = {"weightCol": "weight"} if self.weighted else {}
        if self.kind == "decision_tree":
            return DecisionTreeClassifier(**common, **weight)
        if self.kind == "random_forest":
            return RandomForestClassifier(numTrees=self.trees, **common, **weight)
        raise ValueError(f"kind: {self.kind}")


def assembled(df: DataFrame, label: str, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds the vector ``features`` and the label as double ``y``; drops the single feature columns."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    kept = [c for c in vector.columns if c not in FEATURES]
    return vector.select(*kept, F.col(label).cast("double").alias("y"))


def weighted(df: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Adds balanced class weights for ``y``, from ``df`` itself or from another frame's classes."""
    return with_weights(df, "y", weights)


def predict(model, rows: DataFrame, name: str = "y_pred") -> DataFrame:
    scored = model.transform(rows)
    extra = [c for c in ("rawPrediction", "probability") if c in scored.columns]
    return scored.drop(*extra).withColumn(name, F.col("prediction").cast("bigint")).drop("prediction")


# Fits that run side by side.
PARALLEL_FITS = 5


def _side_by_side(runs: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """Store every run's rows and read them as one table."""
    with ThreadPool(min(PARALLEL_FITS, len(runs))) as pool:
        return reduce(DataFrame.unionByName, pool.map(lambda run: stored(run(), "predictions"), runs))


def _keys(rows: DataFrame) -> list[str]:
    return ["ip", *(c for c in ("slice", "slice_no") if c in rows.columns)]


def boosted_nodes(rows: DataFrame, settings: Trees, models: Column, depths: dict[str, int | None]) -> DataFrame:
    """Node table of boosted models; rows without weights count alike."""
    plain = rows if settings.weighted and "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    return boosting.fit(plain, models, settings.iterations, depths, _keys(rows))


def _boosted_folds(rows: DataFrame, settings: Trees, folds: Sequence[int], depths: Sequence[int | None]) -> DataFrame:
    """depth (null: no limit), fold, part, keys, y_true, y_pred of every depth and fold: one fit, one scoring."""
    every = [(d, f) for d in depths for f in folds]
    names = {pair: f"{pair[0]}|{pair[1]}" for pair in every}
    training = F.array_compact(F.array(*(F.when(F.col("fold") != f, F.lit(names[d, f])) for d, f in every)))
    nodes = boosted_nodes(rows, settings, training, {names[pair]: pair[0] for pair in every})
    kept = rows.select("*", F.col("fold").alias("own"), F.col("y").cast("bigint").alias("y_true"))
    keys = _keys(rows)
    scored = boosting.predict(kept, nodes, F.array(*map(F.lit, names.values())), [*keys, "own", "y_true"])
    fold = F.substring_index("model", "|", -1).cast("int")
    return scored.select(
        F.expr("try_cast(substring_index(model, '|', 1) AS int)").alias("depth"),
        fold.alias("fold"),
        F.when(F.col("own") == fold, "test").otherwise("train").alias("part"),
        *keys,
        "y_true",
        "y_pred",
    )


def _fold_run(rows: DataFrame, settings: Trees, fold: int, tags: dict) -> Callable[[], DataFrame]:
    keys = _keys(rows)

    def run() -> DataFrame:
        model = settings.estimator().fit(rows.filter(F.col("fold") != fold))
        part = F.when(F.col("fold") == fold, "test").otherwise("train")
        return predict(model, rows).select(
            *[F.lit(v).alias(k) for k, v in tags.items()],
            F.lit(fold).alias("fold"),
            part.alias("part"),
            *keys,
            F.col("y").cast("bigint").alias("y_true"),
            "y_pred",
        )

    return run


def _depths_run(
    rows: DataFrame, settings: Trees, fold: int, fitted: Sequence[int], forest: DataFrame | None = None
) -> Callable[[], DataFrame]:
    """Every depth of a tree or forest from one fit at the largest (see ``depths``), or from the nodes ``forest`` of all folds."""

    def run() -> DataFrame:
        kept = rows.select("features", "fold", F.col("y").cast("bigint").alias("y_true"))
        part = F.when(F.col("fold") == fold, "test").otherwise("train")
        if forest is None:
            model = replace(settings, depth=max(fitted)).estimator().fit(rows.filter(F.col("fold") != fold))
            scored = predict_depths(model, kept, fitted, ["fold", "y_true"])
        else:
            scored = predict_nodes(forest.filter(F.col("fold") == fold).drop("fold"), kept, fitted, ["fold", "y_true"])
        return scored.select(
            F.lit(settings.kind).alias("kind"),
            F.col("depth").alias("max_depth"),
            part.alias("part"),
            F.lit(fold).alias("fold"),
            "y_true",
            "y_pred",
        )

    return run


def cross_validate(rows: DataFrame, settings: Trees, folds: Sequence[int] = range(5), **tags) -> DataFrame:
    """Fit on all folds but one, predict both parts: (tags, fold, part, ip, y_true, y_pred).

    ``rows`` comes from ``assembled`` with ``weight`` and ``fold``; class weights are those of all rows.
    """
    if settings.is_boosted:
        scored = _boosted_folds(rows, settings, folds, [settings.depth]).drop("depth")
        return stored(scored.select(*[F.lit(v).alias(k) for k, v in tags.items()], *scored.columns), "predictions")
    return _side_by_side([_fold_run(rows, settings, fold, tags) for fold in folds])


def depth_grid(
    rows: DataFrame, base: Sequence[Trees], depths: Sequence[int | None] = DEPTH_GRID, folds: Sequence[int] = range(5)
) -> DataFrame:
    """Mean macro-F1 on test and train parts per model kind and fitted depth, and their difference.

    Boosted trees have every depth of the grid, and null for unlimited depth. For the other kinds depths beyond MLlib's
    limit, and unlimited depth, are one entry: that limit. They are fitted once per fold, at the largest depth, whose first
    levels are the models of the smaller ones.
    """
    fitted = sorted({MAX_DEPTH if d is None else min(d, MAX_DEPTH) for d in depths})
    runs = []
    for settings in base:
        if settings.is_boosted:
            runs.append(
                lambda settings=settings: _boosted_folds(rows, settings, folds, depths).select(
                    F.lit(settings.kind).alias("kind"), F.col("depth").alias("max_depth"), "fold", "part", "y_true", "y_pred"
                )
            )
            continue
        forest = None
        if settings.kind == "random_forest" and rows.count() <= forests.FOREST_ROWS:
            forest = forests.fit(rows, folds, settings.trees, max(fitted), settings.weighted, settings.seed, _keys(rows))
        runs += [_depths_run(rows, settings, fold, fitted, forest) for fold in folds]
    by = ["kind", "max_depth"]
    # Each fit leaves its counts of (true, predicted) pairs only.
    counted = _side_by_side([lambda run=run: pair_counts(run(), "y_true", "y_pred", [*by, "fold", "part"]) for run in runs])
    scores = macro_f1_of_counts(counted, [*by, "fold", "part"])
    score = {p: F.avg(F.when(F.col("part") == p, F.col("macro_f1"))) for p in ("test", "train")}
    return scores.groupBy(*by).agg(
        score["test"].alias("mean_test_score"),
        score["train"].alias("mean_train_score"),
        (score["test"] - score["train"]).alias("test_vs_train"),
    )


def ablation(
    table: DataFrame,
    label: str,
    settings: Trees,
    groups: Sequence[str] = tuple(FEATURE_GROUPS),
    folds: Sequence[int] = range(5),
) -> DataFrame:
    """Cross-validated predictions per nested feature set; ``table`` holds features, label and fold."""
    runs = []
    for group in groups:
        rows = weighted(assembled(table, label, FEATURE_GROUPS[group]))
        runs.append(cross_validate(rows, settings, folds, feature_group=group))
    return reduce(DataFrame.unionByName, runs)


def feature_importances(model, spark, features: Sequence[str] = FEATURES, top: int = 10) -> DataFrame:
    """The most important features of a fitted tree or forest."""
    rows = [(name, float(value)) for name, value in zip(features, model.featureImportances.toArray())]
    frame = spark.createDataFrame(rows, "feature string, importance double")
    return frame.orderBy(F.desc("importance"), "feature").limit(top)


def static_vs_slice(
    static_rows: DataFrame, slice_rows: DataFrame, settings: Trees, held_out: Column
) -> DataFrame:
    """Score slice rows of held-out hosts by a whole-period model and by a slice-trained model.

    Both frames are ``assembled`` and carry the columns ``held_out`` tests; output: (ip, slice, slice_no, y_true,
    pred_static, pred_slice).
    """
    sides = (rows.withColumn("fold", F.when(held_out, 0).otherwise(1)) for rows in (static_rows, slice_rows))
    return static_vs_slice_folds(*sides, settings, (0,)).drop("fold")


def _boosted_both(static_rows, slice_rows, settings: Trees, folds: Sequence[int], refit: bool) -> DataFrame:
    weights = class_weights(static_rows, "y")
    names = {f: str(f) for f in folds}
    training = F.array_compact(F.array(*(F.when(F.col("fold") != f, F.lit(n)) for f, n in names.items())))
    own = F.array(F.col("fold").cast("string"))
    depths = dict.fromkeys(names.values(), settings.depth)
    whole = own if refit else F.array(F.lit("whole"))
    static_nodes = boosted_nodes(
        weighted(static_rows, weights),
        settings,
        training if refit else whole,
        depths if refit else {"whole": settings.depth},
    )
    slice_nodes = boosted_nodes(weighted(slice_rows, weights), settings, training, depths)
    rows = stored(slice_rows.filter(F.col("fold").isin(*folds)).withColumn("y_true", F.col("y").cast("bigint")), "held-out")
    keys = ["ip", "slice", "slice_no", "fold"]
    by_static = boosting.predict(rows, static_nodes, whole, [*keys, "y_true"], "pred_static").drop("model")
    by_slice = boosting.predict(rows, slice_nodes, own, keys, "pred_slice").drop("model")
    both = by_static.join(by_slice, keys).select("ip", "slice", "slice_no", "y_true", "pred_static", "pred_slice", "fold")
    return stored(both, "predictions")


def score_both(static_model, slice_model, rows: DataFrame) -> DataFrame:
    both = predict(slice_model, predict(static_model, rows, "pred_static"), "pred_slice")
    return both.select(
        "ip", "slice", "slice_no", F.col("y").cast("bigint").alias("y_true"), "pred_static", "pred_slice"
    )


def static_vs_slice_folds(
    static_rows: DataFrame, slice_rows: DataFrame, settings: Trees, folds: Sequence[int] = range(5), static_model=None
) -> DataFrame:
    """``static_vs_slice`` once per fold, with the ``fold`` column.

    The whole-period model is fitted anew per fold. Pass a fitted ``static_model`` to score that one in
    every fold instead (for boosted trees True: one is fitted on all rows); hosts held out of a fold may then have been
    among its training hosts.
    """
    if settings.is_boosted:
        return _boosted_both(static_rows, slice_rows, settings, folds, refit=static_model is None)
    weights = class_weights(static_rows, "y")

    def fold_run(fold: int) -> Callable[[], DataFrame]:
        held_out = F.col("fold") == fold

        def run() -> DataFrame:
            whole = static_model or settings.estimator().fit(weighted(static_rows.filter(~held_out), weights))
            sliced = settings.estimator().fit(weighted(slice_rows.filter(~held_out), weights))
            return score_both(whole, sliced, slice_rows.filter(held_out)).withColumn("fold", F.lit(fold))

        return run

    return _side_by_side([fold_run(fold) for fold in folds])


def fold_importances(rows: DataFrame, settings: Trees, folds: Sequence[int] = range(5), top: int = 10) -> DataFrame:
    """The most important features of the model of every fold: (fold, feature, importance)."""
    if settings.is_boosted:
        training = F.array_compact(F.array(*(F.when(F.col("fold") != f, F.lit(str(f))) for f in folds)))
        nodes = boosted_nodes(rows, settings, training, {str(f): settings.depth for f in folds})
        found = boosting.importances(nodes, FEATURES)
        rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= top)
        return best.select(F.col("model").cast("int").alias("fold"), "feature", "importance")

    def fold_run(fold: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            model = settings.estimator().fit(rows.filter(F.col("fold") != fold))
            return feature_importances(model, rows.sparkSession, top=top).withColumn("fold", F.lit(fold))

        return run

    return _side_by_side([fold_run(fold) for fold in folds])


def projection(rows: DataFrame, *keep: str) -> DataFrame:
    """Two principal axes of the unit-length feature vectors, where distance follows the cosine."""
    unit = Normalizer(inputCol="features", outputCol="unit").transform(rows)
    axes = PCA(k=2, inputCol="unit", outputCol="axes").fit(unit).transform(unit)
    point = vector_to_array("axes")
    return axes.select(*keep, point[0].alias("x"), point[1].alias("y"))
