import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tricolor.operators.metrics import auc
from tricolor.operators.models.catalog import model
from tricolor.operators.models.plsda import kernel_pls1
from tricolor.operators.pca import PcaModel


def _toy(spark, n=200):
    rng = np.random.default_rng(1)
    y = (np.arange(n) % 3 == 0).astype(int)
    a = rng.normal(size=n) + 2.0 * y
    b = rng.normal(size=n) - 1.0 * y
    rows = [(i + 1, float(a[i]), float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, y long"), a, b, y


def test_nb_matches_closed_form(spark):
    df, a, b, y = _toy(spark)
    fitted = model("NB").fit(df, ["a", "b"], "y")
    got = {r["row_id"]: r["NB_Prob"] for r in fitted.predict(df).collect()}
    X = np.column_stack([a, b])
    eps = 1e-9 * X.var(0).max()
    jll = []
    for c in (0, 1):
        Xc = X[y == c]
        m, v = Xc.mean(0), Xc.var(0) + eps
        jll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * v).sum() - ((X - m) ** 2 / (2 * v)).sum(1))
    p1 = 1 / (1 + np.exp(jll[0] - jll[1]))
    assert all(got[i + 1] == pytest.approx(p1[i], rel=1e-9) for i in range(len(y)))


def _nipals_pls1(X, y, k):
    Xs = (X - X.mean(0)) / X.std(0, ddof=1)
    ys = (y - y.mean()) / y.std(ddof=1)
    W, P, Q = [], [], []
    E, f = Xs.copy(), ys.copy()
    for _ in range(k):
        w = E.T @ f
        w /= np.linalg.norm(w)
        t = E @ w
        p = E.T @ t / (t @ t)
        q = f @ t / (t @ t)
        E = E - np.outer(t, p)
        f = f - q * t
        W.append(w); P.append(p); Q.append(q)
    W, P = np.column_stack(W), np.column_stack(P)
    return W @ np.linalg.inv(P.T @ W) @ np.array(Q)


def test_kernel_pls_matches_nipals():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(80, 5))
    y = (X[:, 0] + 0.5 * X[:, 1] + rng.normal(size=80) > 0).astype(float)
    Xs = (X - X.mean(0)) / X.std(0, ddof=1)
    ys = (y - y.mean()) / y.std(ddof=1)
    for k in (1, 2, 4):
        assert np.allclose(kernel_pls1(Xs.T @ Xs, Xs.T @ ys, k), _nipals_pls1(X, y, k), atol=1e-10)


@pytest.mark.parametrize("name", ["Ridge", "Lasso", "DecisionTree", "RandomForest", "KNN", "PLSDA"])
def test_models_learn_toy_task(spark, name):
    df, *_ = _toy(spark)
    fitted = model(name).fit(df, ["a", "b"], "y")
    p = fitted.predict(df)
    probs = p.select(f"{name}_Prob").collect()
    assert len(probs) == 200
    if name != "PLSDA":
        assert all(0.0 <= r[0] <= 1.0 for r in probs)
    assert auc(p, "y", f"{name}_Prob").first()["auc"] >= 0.85


def test_pca_ratios_and_orthogonality(spark):
    df, *_ = _toy(spark)
    m = PcaModel.fit(df, ["a", "b"])
    assert sum(m.explained) == pytest.approx(1.0)
    pc = np.array(m.components)
    assert np.allclose(pc.T @ pc, np.eye(2), atol=1e-9)
    scores = m.transform(df, 2).collect()
    assert len(scores) == 200 and not math.isnan(scores[0]["PC1"])
    cum = [r["cumulative"] for r in m.variance(spark).orderBy("pc").collect()]
    assert cum[-1] == pytest.approx(1.0)
    assert F is not None


def test_poly3_map_reproduces_kernel():
    from tricolor.operators.models.svm import poly3_map
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=4), rng.normal(size=4)
    g = 0.3
    phi = lambda v: np.array([s * np.prod([v[i] for i in idx]) for s, idx in poly3_map(4, g)])
    assert phi(x) @ phi(y) == pytest.approx((g * x @ y) ** 3, rel=1e-12)


def test_svm_poly_kernel_learns(spark):
    df, *_ = _toy(spark, 120)
    fitted = model("SVM", kernel="poly", max_iter=20).fit(df, ["a", "b"], "y")
    p = fitted.predict(df)
    assert auc(p, "y", "SVM_Prob").first()["auc"] >= 0.8


def test_stacking_refuses_plsda_and_voting(spark):
    from tricolor.operators.models.ensemble import Stacking, Voting
    df, *_ = _toy(spark, 60)
    with pytest.raises(ValueError):
        Stacking("S", [model("NB"), model("PLSDA")]).fit(df, ["a", "b"], "y")
    with pytest.raises(ValueError):
        Stacking("S", [model("NB"), Voting("V", [model("NB"), model("Ridge")])]).fit(df, ["a", "b"], "y")


def test_importances(spark):
    from tricolor.operators import importance as imp
    rng = np.random.default_rng(4)
    n = 300
    y = rng.integers(0, 2, n)
    informative = y * 2.0 + rng.normal(scale=0.3, size=n)
    noise = rng.normal(size=n)
    df = spark.createDataFrame([(i + 1, float(informative[i]), float(noise[i]), int(y[i])) for i in range(n)],
                               "row_id long, good double, noise double, y long")
    rf = {r["feature"]: r["importance"] for r in imp.rf_importance(df, ["good", "noise"], "y", 20).collect()}
    assert sum(rf.values()) == pytest.approx(1.0) and rf["good"] > rf["noise"]
    la = {r["feature"]: r["importance"] for r in imp.lasso_importance(df, ["good", "noise"], "y").collect()}
    assert la["good"] > la["noise"] >= 0.0
    fitted = model("RandomForest", n_estimators=20).fit(df, ["good", "noise"], "y")
    perm = {r["feature"]: r["importance"] for r in imp.permutation_importance(fitted, df, ["good", "noise"], "y",
                                                                              repeats=3).collect()}
    assert perm["good"] > 0.2 and abs(perm["noise"]) < 0.1
    mi = {r["feature"]: r["importance"] for r in imp.mutual_information(df, ["good", "noise"], "y").collect()}
    assert mi["good"] > mi["noise"] >= 0.0
    top = imp.ranked(imp.rf_importance(df, ["good", "noise"], "y", 20), top=1).collect()
    assert [r["feature"] for r in top] == ["good"]
