"""Staged ensembles against separate fits and against the trees' own votes."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tricolor.operators.models.base import assemble, pred_col, prob_col
from tricolor.operators.models.catalog import model
from tricolor.operators.models.staged import StagedClassifier, staged_scores
from tricolor.operators.tune import candidate_scores, search_cv


@pytest.fixture(scope="module")
def toy(spark):
    g = np.random.default_rng(2)
    y = g.integers(0, 2, 180)
    x = g.normal(size=(180, 2)) + y[:, None]
    rows = [(i + 1, float(x[i, 0]), float(x[i, 1]), int(y[i]), i % 3) for i in range(180)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y long, fold int").coalesce(1).persist()


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_boosting_equals_a_separate_fit_at_each_count(toy, subsample):
    cands = [{"n_estimators": n, "max_depth": 2, "subsample": subsample} for n in (4, 1, 8)]
    got = {(r.candidate, r.row_id): (r.pred, r.prob) for r in candidate_scores(model("GBM"), cands, toy, ["a", "b"], "y", 3).collect()}
    assert len(got) == 3 * 180
    for i, c in enumerate(cands):
        for f in range(3):
            for r in model("GBM", **c).fit(toy.where(F.col("fold") != f), ["a", "b"], "y").predict(toy.where(F.col("fold") == f)).collect():
                assert got[i, r.row_id] == (r[pred_col("GBM")], pytest.approx(r[prob_col("GBM")], rel=1e-9))


@pytest.mark.parametrize("name", ["RandomForest", "Bagging"])
def test_forest_votes_are_those_of_its_first_trees(toy, name):
    fitted = model(name, n_estimators=6).fit(toy, ["a", "b"], "y")
    got = {}
    for r in staged_scores(fitted.model, toy, ["row_id"], ["a", "b"], [1, 3, 6]).collect():
        got[r["_at"], r.row_id] = (r.pred, r.prob)
    rows = assemble(toy, ["a", "b"])
    own = []
    for t in fitted.model.trees:
        p = t.transform(rows).select("row_id", vector_to_array("probability")[1].alias("p")).collect()
        own.append({r.row_id: r.p for r in p})
    for at, m in enumerate((1, 3, 6)):
        for i in range(1, 181):
            assert got[at, i][1] == pytest.approx(sum(o[i] for o in own[:m]) / m, abs=1e-12)
    for r in fitted.predict(toy).collect():
        assert got[2, r.row_id][1] == pytest.approx(r[prob_col(name)], abs=1e-12)
        assert got[2, r.row_id][0] == r[pred_col(name)] or abs(r[prob_col(name)] - 0.5) < 1e-12


def test_a_grid_fits_once_for_each_setting_and_fold(toy, monkeypatch):
    fits = []
    plain = StagedClassifier.fit
    monkeypatch.setattr(StagedClassifier, "fit", lambda self, *a: (fits.append(dict(self.params)), plain(self, *a))[1])
    points = [{"n_estimators": n, "max_depth": d} for n in (3, 6, 9) for d in (2, 3)]
    best, results, _ = search_cv(model("RandomForest"), points, toy.drop("fold"), ["a", "b"], "y", k=3)
    assert len(results) == 6 and best in points and all(0.6 < s <= 1 for _, s in results)
    assert len(fits) == 2 * 3 + 1 and all(f["n_estimators"] == 9 for f in fits[:-1]) and fits[-1] == best


def test_missing_values_go_the_way_of_the_model(toy):
    fitted = model("RandomForest", n_estimators=4).fit(toy, ["a", "b"], "y")
    odd = toy.limit(20).withColumn("a", F.lit(None).cast("double"))
    got = {r.row_id: r.prob for r in staged_scores(fitted.model, odd, ["row_id"], ["a", "b"], [4]).collect()}
    want = {r.row_id: r[prob_col("RandomForest")] for r in fitted.predict(odd).collect()}
    assert got == {i: pytest.approx(p, abs=1e-12) for i, p in want.items()}
