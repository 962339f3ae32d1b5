import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hostloom.operators import dataset as D
from hostloom.operators import evaluation as E


def hosts(spark, n=3000):
    # One class holds most of the hosts.
    return spark.createDataFrame([(f"10.0.{i // 256}.{i % 256}", 4 if i % 10 else i % 4) for i in range(n)], "ip string, y bigint")


def test_rank_is_the_hash_order_within_each_class(spark):
    ranked = D.stratified_rank(hosts(spark), "y", seed=3).collect()
    classes = defaultdict(list)
    for r in ranked:
        classes[r.y].append((hashlib.md5(f"{r.ip}|3".encode()).hexdigest(), r.ip, r.rank, r.class_size))
    for rows in classes.values():
        rows.sort()
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
        assert {r[3] for r in rows} == {len(rows)}


def test_split_and_folds(spark):
    df = hosts(spark, 1003)
    sizes = Counter(r.y for r in df.collect())
    split = D.stratified_split(df, "y").collect()
    assert len(split) == 1003
    tests = Counter(r.y for r in split if r.part == "test")
    assert tests == {c: math.ceil(n / 5) for c, n in sizes.items()}
    folds = D.stratified_folds(df, "y").collect()
    assert sorted(r.ip for r in folds) == sorted(r.ip for r in split)
    for c, n in sizes.items():
        per_fold = Counter(r.fold for r in folds if r.y == c)
        assert set(per_fold) == set(range(min(5, n))) and max(per_fold.values()) - min(per_fold.values()) <= 1
    assert {r.ip: r.fold for r in folds} == {r.ip: r.fold for r in D.stratified_folds(df.repartition(3), "y").collect()}


def test_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "y bigint")
    assert {r.y: r.weight for r in D.class_weights(df, "y").collect()} == {0: 4 / (2 * 3), 2: 4 / 2}
    assert sum(r.weight for r in D.with_weights(df, "y").collect()) == pytest.approx(4)


def test_density_sums_to_one(spark):
    rng = random.Random(1)
    rows = [(rng.choice([2, 4]), rng.choice([0.0, 10 ** rng.uniform(-3, 6), 1000.0]), 5.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "label bigint, a double, b double")
    found = D.feature_density(df, ["a", "b"]).collect()
    for feature in ("a", "b"):
        for label in (2, 4):
            part = [r for r in found if r.feature == feature and r.label == label]
            assert sum(r.density for r in part) * 0.1 == pytest.approx(1)
            values = [r[1] if feature == "a" else r[2] for r in rows if r[0] == label]
            assert {r.bin: r.n for r in part} == Counter(math.floor(math.log10(v) * 10) for v in values if v > 0)


def predictions(spark, seed=2, n=900):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        true = rng.choice([0, 2, 3, 4, 4])
        pred = true if rng.random() < 0.6 else rng.choice([1, 2, 3, 4])
        s = rng.randrange(1, 13)
        rows.append((f"h{rng.randrange(150)}", f"d1_{s}", s, rng.randrange(5), true, pred))
    return rows, spark.createDataFrame(rows, "ip string, slice string, slice_no bigint, fold bigint, y bigint, p bigint")


def test_report_and_confusion(spark):
    rows, df = predictions(spark)
    pairs = Counter((r[4], r[5]) for r in rows)
    report = {r.label: r for r in E.classification_report(df, "y", "p").collect()}
    f1s = {}
    for c in range(5):
        tp = pairs[c, c]
        support = sum(n for (t, _), n in pairs.items() if t == c)
        predicted = sum(n for (_, p), n in pairs.items() if p == c)
        f1s[c] = 2 * tp / (support + predicted)
        r = report[str(c)]
        assert r.support == support
        assert r.precision == pytest.approx(tp / predicted if predicted else 0)
        assert r.recall == pytest.approx(tp / support if support else 0)
        assert r.f1 == pytest.approx(f1s[c])
    assert report["macro avg"].f1 == pytest.approx(sum(f1s.values()) / 5)
    assert report["accuracy"].f1 == pytest.approx(sum(pairs[c, c] for c in range(5)) / len(rows))
    assert E.macro_f1(df, "y", "p").first().macro_f1 == pytest.approx(sum(f1s.values()) / 5)
    per_fold = E.macro_f1(df, "y", "p", ["fold"]).collect()
    for r in per_fold:
        assert r.macro_f1 == pytest.approx(E.macro_f1(df.filter(F.col("fold") == r.fold), "y", "p").first().macro_f1)
    for r in E.confusion_matrix(df, "y", "p").collect():
        assert [r[f"pred_{c}"] for c in range(5)] == [pairs[r.true, c] for c in range(5)]
    for r in E.confusion_matrix(df, "y", "p", normalize=True).collect():
        assert sum(r[f"pred_{c}"] for c in range(5)) == pytest.approx(int(r.true != 1))  # 1 is never true


def test_merged_predictions(spark):
    rows, df = predictions(spark)
    by_host = defaultdict(Counter)
    for r in rows:
        by_host[r[0]][r[5]] += 1
    second, first = {}, {}
    for ip, counts in by_host.items():
        order = sorted(counts, key=lambda c: (-counts[c], c))
        first[ip], second[ip] = order[0], order[min(1, len(order) - 1)]
    assert {r.ip: r.pred for r in E.merged_predictions(df, "p").collect()} == second
    assert {r.ip: r.pred for r in E.merged_predictions(df, "p", majority=True).collect()} == first
    repeated = {r.ip: r.repeated for r in E.repeat_hosts(df).collect()}
    assert repeated == {ip: sum(c.values()) > 1 for ip, c in by_host.items()}


def test_accuracy_over_slices(spark):
    rows, df = predictions(spark)
    counted = [r for r in rows if r[4] > 1]
    matrix = E.accuracy_fold_matrix(df, "y", "p", range(5)).collect()
    assert [r.order for r in matrix] == list(range(1, 13))
    for r in matrix:
        for f in range(5):
            hits = [a[4] == a[5] for a in counted if a[2] == r.order and a[3] == f]
            assert r[f"preds{f}"] == (pytest.approx(sum(hits) / len(hits)) if hits else None)
    melted = E.accuracy_melt(E.accuracy_fold_matrix(df, "y", "p", range(5)))
    assert melted.columns == ["order", "variable", "value"] and melted.count() == 60
    for r in E.accuracy_by_slice(df, "y", "p").collect():
        hits = [a[4] == a[5] for a in counted if a[2] == r.slice_no]
        assert r.accuracy == pytest.approx(sum(hits) / len(hits))


def test_weights_of_another_frame_lose_no_row(spark):
    weights = spark.createDataFrame([(0, 2.0), (1, 3.0)], "y bigint, weight double")
    df = spark.createDataFrame([("a", 0), ("b", 2)], "ip string, y bigint")
    assert {r.ip: r.weight for r in D.with_weights(df, "y", weights).collect()} == {"a": 2.0, "b": 1.0}
    with pytest.raises(Exception, match="null in y"):
        D.with_weights(df.selectExpr("ip", "nullif(y, 2) AS y"), "y", weights).collect()


def test_confusion_has_a_row_per_class_and_refuses_others(spark):
    df = spark.createDataFrame([(5, 5), (5, 3), (2, 0)], "y bigint, p bigint")
    rows = {r.true: r for r in E.confusion_matrix(df, "y", "p", classes=range(6)).collect()}
    assert set(rows) == set(range(6)) and (rows[5].pred_5, rows[5].pred_3, rows[2].pred_0) == (1, 1, 1)
    assert sum(rows[0][f"pred_{c}"] for c in range(6)) == 0
    with pytest.raises(Exception, match="class outside the matrix"):
        E.confusion_matrix(df, "y", "p").collect()


def test_automatic_bins_follow_the_spread(spark):
    rng = random.Random(5)
    wide = [10 ** rng.gauss(0, 2) for _ in range(700)]
    narrow = [10 ** rng.gauss(3, 0.01) for _ in range(300)]
    rows = [(i % 3, w, narrow[i] if i < 300 else None, 7.0 if i < 2 else 0.0, -1.0) for i, w in enumerate(wide)]
    rows += [(1, math.inf, math.nan, None, 0.0), (None, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "label int, wide double, narrow double, single double, none double")
    names = ["wide", "narrow", "single", "none"]
    logs = {n: sorted(round(math.log10(v), 9) for v in map(lambda r: r[i], rows) if v and 0 < v < math.inf) for i, n in enumerate(names, 1)}
    bins = {r["feature"]: r for r in D.automatic_bins(df, names).collect()}
    assert set(bins) == {"wide", "narrow", "single"}
    assert (bins["single"]["low"], bins["single"]["width"], bins["single"]["bins"]) == (logs["single"][0] - 0.5, 1.0, 1)
    for name in ("wide", "narrow"):
        x = logs[name]
        quartiles = [x[math.ceil(len(x) * q) - 1] for q in (0.25, 0.75)]
        width = min(2 * (quartiles[1] - quartiles[0]) / len(x) ** (1 / 3), (x[-1] - x[0]) / (math.log2(len(x)) + 1))
        assert bins[name]["bins"] == math.ceil((x[-1] - x[0]) / width - 1e-9)
        assert bins[name]["width"] == pytest.approx((x[-1] - x[0]) / bins[name]["bins"])
    assert bins["wide"]["width"] > 50 * bins["narrow"]["width"]
    mass = defaultdict(float)
    seen = Counter()
    for r in D.automatic_density(df, names).collect():
        mass[r["feature"], r["label"]] += r["density"] * r["width"]
        seen[r["feature"]] += r["n"]
        assert 0 <= r["bin"] < bins[r["feature"]]["bins"]
    assert all(m == pytest.approx(1) for m in mass.values())
    assert seen == {n: len(x) for n, x in logs.items() if x}
    assert D.automatic_density(df.filter("false"), names).collect() == []
