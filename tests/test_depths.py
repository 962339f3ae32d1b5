"""All depths from one fit against a fit per depth."""

import random

import pytest
from pyspark.sql import functions as F

from hostloom.operators import dataset as D
from hostloom.operators import models as M
from hostloom.operators.depths import predict_depths
from hostloom.schema import FEATURES


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    table = []
    for i in range(400):
        x = [round(rng.gauss(0, 1), 1) for _ in range(94)]
        y = (x[0] > 0) + 2 * (x[1] > 0.4) if rng.random() < 0.8 else rng.randrange(4)
        table.append((f"10.0.{i // 100}.{i % 100}", int(y), *x))
    columns = ", ".join(f"`{f}` double" for f in FEATURES)
    df = spark.createDataFrame(table, f"ip string, y_label bigint, {columns}").repartition(3)
    return M.weighted(M.assembled(D.stratified_folds(df, "y_label", 3), "y_label")).cache()


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest"])
def test_every_depth_equals_its_own_fit(rows, kind):
    depths = [1, 2, 4, 6, 30]
    training = rows.filter("fold <> 0")
    settings = M.Trees(kind, depth=30, trees=7)
    got = {}
    for r in predict_depths(settings.estimator().fit(training), rows, depths, ["ip", "fold"]).collect():
        got.setdefault(r["depth"], {})[r["ip"]] = r["y_pred"]
    assert sorted(got) == depths
    for depth in depths:
        model = M.replace(settings, depth=depth).estimator().fit(training)
        assert got[depth] == {r["ip"]: r["y_pred"] for r in M.predict(model, rows).collect()}, depth


def test_the_grid_fits_once_per_kind_and_fold(rows, monkeypatch):
    fitted, estimator = [], M.Trees.estimator
    monkeypatch.setattr(M.Trees, "estimator", lambda self: fitted.append((self.kind, self.depth)) or estimator(self))
    grid = M.depth_grid(rows, [M.Trees("decision_tree")], depths=(1, 4, 32, None), folds=(0, 1)).collect()
    assert fitted == [("decision_tree", 30)] * 2
    assert {r["max_depth"] for r in grid} == {1, 4, 30}
    # The scores are those of a fit per depth.
    for r in grid:
        own = M.cross_validate(rows, M.Trees("decision_tree", depth=r["max_depth"]), (0, 1))
        score = M.macro_f1_of_counts(M.pair_counts(own, "y_true", "y_pred", ["fold", "part"]), ["fold", "part"])
        want = score.filter("part = 'test'").agg(F.avg("macro_f1")).first()[0]
        assert r["mean_test_score"] == pytest.approx(want)
