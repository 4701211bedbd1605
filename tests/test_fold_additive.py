import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators.models.additive import Moments, class_moments, merged, product_moments
from tricolor.operators.models.base import pred_col, prob_col
from tricolor.operators.models.catalog import grid, model
from tricolor.operators.tune import candidate_scores, candidates, cv_summary, fold_metrics, out_of_fold, search_cv

COLS = ["a", "b", "c"]


def folded(spark, n=160, k=4, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 3)) * [1, 50, 1e-3] + y[:, None] * [1.0, 20, 1e-3] + [0, 1e6, 0]
    rows = [(i + 1, *map(float, x[i]), int(y[i]), int(i % k)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, y long, fold int")


def test_moments_add_up_to_those_of_all_rows(spark):
    df = folded(spark)
    x = np.array([[r.a, r.b, r.c, r.y] for r in df.collect()])
    whole = merged(product_moments(df, [*COLS, "y"]).values())
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0), rtol=1e-12)
    assert np.allclose(whole.about, np.cov(x.T, bias=True) * len(x), rtol=1e-9, atol=1e-9)
    per = class_moments(df, COLS, "y")
    ones = merged(m for (_, c), m in per.items() if c == 1)
    assert np.allclose(ones.about, x[x[:, 3] == 1][:, :3].var(0) * ones.n, rtol=1e-9)
    assert merged([]) is None
    assert merged([Moments(1, np.zeros(1), np.zeros(1)), Moments(1, np.ones(1), np.zeros(1))]).about[0] == pytest.approx(0.5)


@pytest.mark.parametrize("name,params", [("NB", [{}, {"var_smoothing": 1e-6}]), ("PLSDA", [{"n_components": 1}, {"n_components": 2}])])
def test_scores_equal_a_fit_per_fold(spark, name, params):
    df, k = folded(spark), 4
    got = {(r.candidate, r.row_id): (r.pred, r.prob) for r in candidate_scores(model(name), params, df, COLS, "y", k).collect()}
    assert len(got) == 160 * len(params)
    for i, p in enumerate(params):
        for f in range(k):
            fitted = model(name, **p).fit(df.where(F.col("fold") != f), COLS, "y")
            for r in fitted.predict(df.where(F.col("fold") == f)).collect():
                pred, prob = got[i, r.row_id]
                assert pred == r[pred_col(name)] and prob == pytest.approx(r[prob_col(name)], rel=1e-6, abs=1e-9)


def test_search_and_metrics_use_one_pass(spark):
    df = folded(spark, 300).drop("fold")
    best, results, fitted = search_cv(model("NB"), grid("NB"), df, COLS, "y", k=5)
    assert len(results) == 5 and best in grid("NB") and all(0.5 < s <= 1 for _, s in results)
    one = folded(spark, 300, 5)
    summary = {r.metric: r for r in cv_summary(fold_metrics(model("NB"), one, COLS, "y", 5)).collect()}
    assert set(summary) == {"accuracy", "precision", "recall", "f1", "auc"} and summary["auc"].mean > 0.6
    plan = out_of_fold(model("NB"), one, COLS, "y", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2 and "Union" not in plan


def test_one_class_in_a_training_part_is_refused(spark):
    df = folded(spark).withColumn("y", (F.col("fold") == 0).cast("long"))
    with pytest.raises(ValueError):
        candidate_scores(model("NB"), [{}], df, COLS, "y", 4)


def test_random_search_draws_some_of_the_grid():
    points = grid("ElasticNet")
    drawn = candidates(points, "random", 10, 42)
    assert len(points) == 25 and len(drawn) == 10 and all(p in points for p in drawn)
    assert drawn != points[:10] and drawn == candidates(points, "random", 10, 42)
