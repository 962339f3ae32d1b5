import random

import pytest
from pyspark.sql import functions as F

from hostloom.operators import dataset as D
from hostloom.operators import models as M
from hostloom.plans import queries
from hostloom.schema import FEATURE_GROUPS, FEATURES


@pytest.fixture(scope="module")
def table(spark):
    """Hosts whose class shows in one feature of each group."""
    rng = random.Random(1)
    rows = []
    for i in range(150):
        y = i % 3
        rows.append((f"10.0.0.{i}", y, *[float(y * 10 + rng.random()) if k % 9 == 0 else rng.random() for k in range(94)]))
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    df = spark.createDataFrame(rows, f"ip string, y_label bigint, {columns}").coalesce(2)
    return D.stratified_folds(df, "y_label", 3).cache()


@pytest.mark.parametrize("kind", M.KINDS)
def test_cross_validation_learns(spark, table, kind):
    rows = M.weighted(M.assembled(table, "y_label"))
    settings = M.Trees(kind, depth=3, iterations=2, trees=5)
    scored = M.cross_validate(rows, settings, (0,), kind=kind)
    assert scored.columns == ["kind", "fold", "part", "ip", "y_true", "y_pred"]
    parts = {r.part: r for r in scored.groupBy("part").agg(F.count("*").alias("n"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("a")).collect()}
    assert parts["test"].n + parts["train"].n == 150
    assert parts["test"].a > 0.9


def test_grid_ablation_and_importance(spark, table):
    rows = M.weighted(M.assembled(table, "y_label"))
    grid = M.depth_grid(rows, [M.Trees("decision_tree")], depths=(1, None), folds=(0, 1)).collect()
    assert sorted(r.max_depth for r in grid) == [1, 30]
    assert all(r.test_vs_train == pytest.approx(r.mean_test_score - r.mean_train_score) for r in grid)
    runs = M.ablation(table, "y_label", M.Trees("decision_tree", depth=2), ("statistics", "all"), folds=(0,))
    assert {r.feature_group for r in runs.select("feature_group").distinct().collect()} == {"statistics", "all"}
    model = M.Trees("decision_tree", depth=3).estimator().fit(rows)
    top = M.feature_importances(model, spark, top=5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance
    assert FEATURES.index(top[0].feature) % 9 == 0


def test_static_and_slice_models_score_the_same_rows(spark, table):
    static = M.assembled(table, "y_label")
    slices = table.withColumns({"slice": F.lit("d1_1"), "slice_no": F.lit(1)})
    sliced = M.assembled(slices, "y_label")
    settings = M.Trees("decision_tree", depth=2)
    both = M.static_vs_slice(static, sliced, settings, F.col("fold") == 0)
    assert both.columns == ["ip", "slice", "slice_no", "y_true", "pred_static", "pred_slice"]
    assert both.count() == table.filter("fold = 0").count()
    folds = M.static_vs_slice_folds(static, sliced, settings, range(3))
    assert folds.count() == 150
    fitted = settings.estimator().fit(M.weighted(static))
    assert M.static_vs_slice_folds(static, sliced, settings, range(3), static_model=fitted).count() == 150


def test_projection_has_two_axes(spark, table):
    points = M.projection(M.assembled(table, "y_label", FEATURE_GROUPS["coarse"]), "ip")
    assert points.columns == ["ip", "x", "y"] and points.count() == 150


def test_registered_runs_are_of_full_size(monkeypatch):
    class Seen(Exception):
        pass

    def seen(rows, settings, *_, **__):
        raise Seen(settings)

    monkeypatch.setattr(queries, "_training_rows", lambda *_: None)
    monkeypatch.setattr(M, "depth_grid", seen)
    monkeypatch.setattr(M, "cross_validate", seen)
    monkeypatch.setattr(M, "fold_importances", seen)
    kinds = set()
    names = ["random_forest", "boosted_trees", "facility", "feature_importance", "depth_grid", "depth_grid_boosted"]
    for name in names:
        with pytest.raises(Seen) as got:
            getattr(queries, f"ml_{name}")(None, "")
        settings = got.value.args[0]
        for s in settings if isinstance(settings, list) else [settings]:
            assert s.iterations == 100 and s.trees == 100
            kinds |= {s.kind} if "grid" in name else set()
    assert kinds == set(M.KINDS)
