"""Hash-drawn bags: exact sizes, draw counts, and fits equal to a fit on the copied rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators.models.bagging import HashBagging, draws, poisson_steps
from tricolor.operators.models.base import prob_col
from tricolor.operators.models.catalog import model


@pytest.fixture(scope="module")
def toy(spark):
    g = np.random.default_rng(5)
    y = g.integers(0, 2, 400)
    x = g.normal(size=(400, 2)) + y[:, None]
    return spark.createDataFrame([(i + 1, float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(400)], "row_id long, a double, b double, y long")


def test_steps_are_those_of_the_poisson_law():
    steps = poisson_steps(1.0)
    assert steps[0] == pytest.approx(np.exp(-1)) and steps[1] == pytest.approx(2 * np.exp(-1))
    assert steps == sorted(steps) and 0 < 1 - steps[-1] < 1e-8


def test_draws_do_not_depend_on_partitions_and_have_their_sizes(toy):
    some = lambda df, **k: sorted((r.fold, r.row_id) for r in draws(df, 6, **k).collect())
    boot = some(toy.repartition(7), max_samples=1.0, bootstrap=True)
    assert boot == some(toy.coalesce(1), max_samples=1.0, bootstrap=True)
    per = np.bincount([f for f, _ in boot], minlength=6)
    assert (abs(per - 400) < 5 * 20).all() and len(set(boot)) < len(boot)
    paste = some(toy, max_samples=0.3, bootstrap=False)
    assert np.bincount([f for f, _ in paste]).tolist() == [120] * 6 and len(set(paste)) == len(paste)
    assert len({tuple(i for f, i in paste if f == t) for t in range(6)}) == 6


@pytest.mark.parametrize("bootstrap", [True, False])
def test_all_bags_of_naive_bayes_equal_a_fit_for_each(toy, bootstrap):
    bagged = HashBagging("Bagged", model("NB"), 4, 0.5, bootstrap)
    got = {r.row_id: r[prob_col("Bagged")] for r in bagged.fit(toy, ["a", "b"], "y").predict(toy).collect()}
    rows, total = draws(toy, 4, 0.5, bootstrap), dict.fromkeys(got, 0.0)
    for t in range(4):
        for r in model("NB").fit(rows.where(F.col("fold") == t), ["a", "b"], "y").predict(toy).collect():
            total[r.row_id] += r[prob_col("NB")] / 4
    assert got == {i: pytest.approx(p, rel=1e-9) for i, p in total.items()}


def test_any_learner_can_be_bagged(toy):
    bagged = HashBagging("Bagged", model("PLSDA"), 3).with_params(n_estimators=2, n_components=1)
    assert bagged.n_estimators == 2 and bagged.base.n_components == 1
    out = bagged.fit(toy, ["a", "b"], "y").predict(toy)
    assert out.columns == [*toy.columns, "Bagged_Prediction", "Bagged_Prob"] and out.where("Bagged_Prob IS NULL").count() == 0
    with pytest.raises(ValueError):
        HashBagging(max_samples=0.0).fit(toy, ["a", "b"], "y")
