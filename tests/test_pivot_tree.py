"""The pivot tree: exact neighbours, copies, excluded folds, and how the work grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators import neighbors as nb
from tricolor.operators.models.base import pred_col, prob_col
from tricolor.operators.models.catalog import model
from tricolor.operators.tune import candidate_scores, search_cv


def frame(spark, vecs, folds=None):
    rows = [(i + 1, [float(x) for x in v], int(folds[i]) if folds is not None else 0) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id long, v array<double>, fold int").repartition(3)


def brute(vecs, k, metric="euclidean", folds=None, own=True):
    out = {}
    for i, v in enumerate(vecs):
        d = nb._dist(v[None], vecs, metric, 2.0)[0]
        free = [j for j in range(len(vecs)) if (own or j != i) and (folds is None or folds[j] != folds[i]) and np.isfinite(d[j])]
        out[i + 1] = [j + 1 for j in sorted(free, key=lambda j: (d[j], j))[:k]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.qid, []).append((r.nn_rank, r.rid))
    return {q: [rid for _, rid in sorted(v)] for q, v in out.items()}


CASES = {
    "clusters": lambda g: (g.normal(size=(12, 3)) * 50)[g.integers(0, 12, 300)] + g.normal(size=(300, 3)),
    "copies": lambda g: np.concatenate([np.zeros((150, 2)), g.integers(0, 3, (100, 2)).astype(float)]),
    "far from zero": lambda g: g.normal(size=(200, 2)) * 1e-3 + 1e9,
    "one row": lambda g: np.ones((1, 2)),
    "overflow": lambda g: np.concatenate([g.normal(size=(40, 2)), [[1e200, 0], [-1e200, 0], [1e-200, 0], [0, 1e-200]]]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_equals_brute_force(spark, case, metric):
    vecs = CASES[case](np.random.default_rng(5))
    df = frame(spark, vecs)
    got = found(nb.knn(df, df, 6, "id", "v", "id", "v", metric=metric, exclude_self=True, block_rows=20))
    assert got == {q: r for q, r in brute(vecs, 6, metric, own=False).items() if r}


def test_own_fold_is_excluded(spark):
    g = np.random.default_rng(9)
    vecs = CASES["clusters"](g)
    vecs[:80] = vecs[0]
    folds = g.integers(0, 4, len(vecs))
    folds[80:] = np.where(vecs[80:, 0] > 0, 0, folds[80:])   # whole cells of one fold
    df = frame(spark, vecs, folds)
    got = found(nb.knn(df, df, 5, "id", "v", "id", "v", block_rows=30, exclude="fold"))
    assert got == brute(vecs, 5, folds=folds)


def test_empty_tables_and_rows_without_a_place(spark):
    df = frame(spark, np.ones((3, 2)))
    none = df.where("id < 0")
    odd = spark.createDataFrame([(7, [1.0, None]), (8, None), (9, [float("nan"), 1.0])], "id long, v array<double>")
    assert nb.knn(df, none, 2, "id", "v", "id", "v").count() == 0
    assert nb.knn(none, df, 2, "id", "v", "id", "v").count() == 0
    assert nb.knn(odd, df, 2, "id", "v", "id", "v").count() == 0
    assert found(nb.knn(df, df.select("id", "v").unionByName(odd), 9, "id", "v", "id", "v")) == {i: [1, 2, 3] for i in (1, 2, 3)}
    with pytest.raises(ValueError):
        nb._dist(np.ones((1, 1)), np.ones((1, 1)), "minkowski", 0.5)


def work(monkeypatch, n):
    """Distances taken for the 5 nearest of every one of n clustered rows, cell by cell in numpy."""
    g = np.random.default_rng(1)
    vecs = (g.normal(size=(200, 3)) * 30)[g.integers(0, 200, n)] + g.normal(size=(n, 3))
    seen = [0]
    plain = nb._dist
    monkeypatch.setattr(nb, "_dist", lambda a, b, m, p: (seen.__setitem__(0, seen[0] + len(a) * len(b)), plain(a, b, m, p))[1])
    tree = nb.PivotTree(vecs[g.permutation(n)[: int(n ** 0.5)]], "euclidean", 2.0)
    cell, far = tree.assign(vecs)
    c = len(tree.leaves)
    near = np.array([[np.sort(far[cell == i])[5] if (cell == i).sum() > 5 else np.inf] for i in range(c)])
    tree.measure(np.bincount(cell, minlength=c)[:, None], near, np.array([far[cell == i].max(initial=0) for i in range(c)]))
    best = np.full((n, 5), np.inf)
    asked, at, tau = tree.visits(vecs, np.zeros(n, np.int64), 6)
    for i in range(c):
        rows, qs = np.flatnonzero(cell == i), asked[at == i]
        if len(rows) and len(qs):
            d, _ = nb.nearest_in_block(qs, vecs[qs], None, tau[qs], rows, vecs[rows], None, min(5, len(rows)), "euclidean", 2.0, True)
            both = np.sort(np.concatenate([best[qs], d], axis=1), axis=1)[:, :5]
            best[qs] = both
    monkeypatch.setattr(nb, "_dist", plain)
    for i in range(0, n, n // 20):
        assert np.allclose(best[i], np.sort(plain(vecs[i:i + 1], vecs, "euclidean", 2.0)[0])[1:6])
    return seen[0]


def test_work_grows_far_less_than_the_square(monkeypatch):
    small, large = work(monkeypatch, 10_000), work(monkeypatch, 100_000)
    assert large < 20 * small and large < 100_000 ** 2 / 50


def task(spark, n=150):
    g = np.random.default_rng(2)
    y = g.integers(0, 2, n)
    x = (g.normal(size=(n, 2)) + y[:, None]).round(1)
    rows = [(i + 1, float(x[i, 0]), float(x[i, 1]), int(y[i]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y long, fold int")


def test_prefix_votes_equal_a_fit_per_fold(spark):
    df = task(spark)
    cands = [{"k": 1}, {"k": 4, "weights": "distance"}, {"k": 3, "metric": "manhattan"}, {"k": 3, "metric": "manhattan", "weights": "distance"},
             {"k": 500}]
    got = {(r.candidate, r.row_id): (r.pred, r.prob) for r in candidate_scores(model("KNN"), cands, df, ["a", "b"], "y", 3).collect()}
    assert len(got) == 150 * len(cands)
    for i, p in enumerate(cands):
        for f in range(3):
            fitted = model("KNN", **p).fit(df.where(F.col("fold") != f), ["a", "b"], "y")
            for r in fitted.predict(df.where(F.col("fold") == f)).collect():
                assert got[i, r.row_id] == (r[pred_col("KNN")], pytest.approx(r[prob_col("KNN")], rel=1e-9))


def test_rows_without_features_have_no_score(spark):
    df = task(spark, 30).withColumn("a", F.when(F.col("row_id") == 4, None).otherwise(F.col("a")))
    got = candidate_scores(model("KNN"), [{"k": 2}, {"k": 3}], df, ["a", "b"], "y", 3).where("prob IS NULL").collect()
    assert sorted((r.candidate, r.row_id, r.pred) for r in got) == [(0, 4, None), (1, 4, None)]


def test_a_grid_takes_one_search_for_each_metric(spark, monkeypatch):
    from tricolor.operators.models import knn as km
    calls = []
    plain = km.knn
    monkeypatch.setattr(km, "knn", lambda *a, **k: (calls.append(k["metric"]), plain(*a, **k))[1])
    points = [{"k": k, "weights": w, "metric": m} for k in (1, 5, 9) for w in ("uniform", "distance") for m in ("euclidean", "manhattan")]
    best, results, fitted = search_cv(model("KNN"), points, task(spark).drop("fold"), ["a", "b"], "y", k=5)
    assert sorted(calls) == ["euclidean", "manhattan"] and len(results) == 12 and best in points
    assert fitted.k == best["k"]
