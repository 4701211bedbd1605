"""Every classifier without a SQL twin separates a toy task."""

import pytest
from pyspark.sql import functions as F

from tricolor.operators.metrics import auc
from tricolor.operators.models.base import pred_col, prob_col
from tricolor.operators.models.catalog import model
from tricolor.operators.models.ensemble import Stacking, Voting

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(i, float(i % 17), float((i * 5) % 13), int((i % 17) + 0.5 * ((i * 5) % 13) > 11)) for i in range(1, 261)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y long").withColumn("a", (F.col("a") - 8) / 5).withColumn(
        "b", (F.col("b") - 6) / 4).persist()


def _check(fitted, name, toy, least=0.9):
    out = fitted.predict(toy)
    assert out.where(F.col(prob_col(name)).isNull() | ~F.col(pred_col(name)).isin(0, 1)).count() == 0
    assert auc(out, "y", prob_col(name)).first()["auc"] >= least


@pytest.mark.parametrize("name,params", [("ElasticNet", {}), ("GBM", {}), ("MLP", {}), ("Bagging", {"n_estimators": 5}), ("Pasting", {"n_estimators": 5}),
                                         ("SVM", {"kernel": "linear", "gamma": "auto"}), ("SVM", {"kernel": "rbf", "gamma": "auto"})])
def test_classifier(toy, name, params):
    _check(model(name, **params).fit(toy, FEATURES, "y"), name, toy)


def test_stack_and_vote(toy):
    _check(Stacking("Stacking", [model("NB"), model("Ridge")], folds=3).fit(toy, FEATURES, "y"), "Stacking", toy)
    members = [model(n).fit(toy, FEATURES, "y") for n in ("NB", "Ridge")]
    _check(Voting.of_fitted("Voting", members), "Voting", toy)
