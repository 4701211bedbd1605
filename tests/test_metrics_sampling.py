import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators import sampling as smp
from tricolor.operators.metrics import auc, confusion_metrics
from tricolor.operators.neighbors import knn


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairwise_with_ties_and_groups(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.randint(0, 1), round(rnd.random(), 1)) for g in ("a", "b") for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in auc(df, "y", "s", ["g"]).collect()}
    for g in ("a", "b"):
        ys = [r[1] for r in rows if r[0] == g]
        ss = [r[2] for r in rows if r[0] == g]
        assert got[g] == pytest.approx(_brute_auc(ys, ss))
    total = auc(df, "y", "s").first()["auc"]
    flipped = auc(df.select("y", (1 - F.col("s")).alias("s")), "y", "s").first()["auc"]
    assert total + flipped == pytest.approx(1.0)


def test_auc_single_class_is_null_and_confusion_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "y int, p int, s double")
    assert auc(df, "y", "s").first()["auc"] is None
    m = confusion_metrics(df, "y", "p").first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (1.0, 0.0, 0.0, 0.0)


def _frame(spark, n=300, pos=60):
    rows = [(i + 1, 1 if i < pos else 0, float(i % 17), float((i * 7) % 13)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y long, a double, b double")


def test_split_exact_and_disjoint(spark):
    s = smp.split_train_val(_frame(spark), 0.2).collect()
    val = [r["row_id"] for r in s if r["is_val"]]
    assert len(val) == 60 and len(s) == 300 and len(set(r["row_id"] for r in s)) == 300


def test_under_over_and_folds(spark):
    df = _frame(spark)
    u = smp.under_sample(df, "y").groupBy("y").count().collect()
    assert sorted(r["count"] for r in u) == [60, 60]
    o = smp.over_sample(df, "y")
    counts = {r["y"]: r["count"] for r in o.groupBy("y").count().collect()}
    assert counts == {0: 240, 1: 240}
    assert o.select("row_id").distinct().count() == 480
    f = smp.stratified_folds(df, "y", 10).groupBy("fold", "y").count().collect()
    per_class = {}
    for r in f:
        per_class.setdefault(r["y"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per_class.values())


def test_blocked_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(120, 3)).round(2)
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = knn(df, df, 4, "id", "v", "id", "v", exclude_self=True, block_rows=25).collect()
    nn = {}
    for r in got:
        nn.setdefault(r["qid"], []).append((r["nn_rank"], r["rid"]))
    for i in range(120):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(1))
        d[i] = np.inf
        order = sorted(range(120), key=lambda j: (d[j], j))[:4]
        assert [rid for _, rid in sorted(nn[i])] == order


def test_smote_rows_lie_between_parent_and_neighbour(spark):
    df = _frame(spark, 120, 20)
    out = smp.smote(df, "y", ["a", "b"], k=3).where("is_synthetic").collect()
    assert len(out) == 80
    minority = np.array([[r["a"], r["b"]] for r in df.where("y = 1").collect()])
    lo, hi = minority.min(0), minority.max(0)
    for r in out:
        assert r["y"] == 1 and lo[0] - 1e-9 <= r["a"] <= hi[0] + 1e-9 and lo[1] - 1e-9 <= r["b"] <= hi[1] + 1e-9


def test_rebalancing_three_classes(spark):
    rows = [(i + 1, c, float(i)) for c, n in ((0, 50), (1, 20), (2, 8)) for i in range(n)]
    rows = [(k + 1, c, x) for k, (_, c, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id long, y long, a double")
    over = {r["y"]: r["count"] for r in smp.over_sample(df, "y").groupBy("y").count().collect()}
    under = {r["y"]: r["count"] for r in smp.under_sample(df, "y").groupBy("y").count().collect()}
    assert over == {0: 50, 1: 50, 2: 50} and under == {0: 8, 1: 8, 2: 8}
    ids = smp.over_sample(df, "y").select("row_id").distinct().count()
    assert ids == 150


def test_auc_with_null_scores_and_null_group(spark):
    rnd = random.Random(9)
    rows = [(g, rnd.randint(0, 1), round(rnd.random(), 1)) for g in ("a", "c", None) for _ in range(80)]
    rows += [("a", 0, None), ("b", 0, 0.1), ("b", 1, 0.9), ("n", 0, None), ("n", 1, None)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in auc(df, "y", "s", ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "n", None} and got["a"] is None and got["n"] is None and got["b"] == 1.0
    for g in ("c", None):
        assert got[g] == pytest.approx(_brute_auc([r[1] for r in rows if r[0] == g], [r[2] for r in rows if r[0] == g]))
    from tricolor.operators.metrics import binary_metrics
    both = {r["g"]: r["auc"] for r in binary_metrics(df.withColumn("p", F.lit(1)), "y", "p", "s", ["g"]).collect()}
    assert both == got
