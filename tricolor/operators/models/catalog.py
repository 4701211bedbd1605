"""The fifteen classifiers, their manual defaults and their tuning grids.

Regularisation strength ``C`` maps to ``regParam = 1 / (C * n)`` (n = training rows), with
``standardization=False`` so the penalty applies to the features as given (after the recipe's
own scaling). Tree ensembles are binned (``maxBins``) and cannot match exact-threshold trees
value for value; they are checked by quality.
"""

from __future__ import annotations

import math
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)

from tricolor.functions.scalar import int_range, linspace, logspace
from tricolor.operators.models.base import Classifier, SparkMLClassifier
from tricolor.operators.models.knn import KNNClassifier
from tricolor.operators.models.nb import GaussianNB
from tricolor.operators.models.plsda import PLSDA
from tricolor.operators.models.staged import StagedClassifier
from tricolor.operators.models.svm import SVMClassifier

SEED = 42
MAX_BINS = 64


def _logistic(n, p, C=1.0, l1_ratio=0.0, max_iter=1000):
    return LogisticRegression(regParam=1.0 / (float(C) * n), elasticNetParam=float(l1_ratio),
                              standardization=False, maxIter=int(max_iter), family="binomial")


def _tree(n, p, max_depth=5, min_samples_leaf=1, criterion="gini", min_samples_split=2):
    # min_samples_split has no counterpart in Spark trees; it is accepted and ignored.
    return DecisionTreeClassifier(maxDepth=int(max_depth), minInstancesPerNode=int(min_samples_leaf),
                                  impurity=criterion, maxBins=MAX_BINS, seed=SEED)


def _rf(n, p, n_estimators=100, max_depth=5, min_samples_leaf=1):
    return RandomForestClassifier(numTrees=int(n_estimators), maxDepth=int(max_depth),
                                  minInstancesPerNode=int(min_samples_leaf), featureSubsetStrategy="sqrt",
                                  maxBins=MAX_BINS, seed=SEED)


def _gbm(n, p, n_estimators=100, learning_rate=0.1, max_depth=3, subsample=1.0, min_samples_leaf=1,
         min_samples_split=2):
    return GBTClassifier(maxIter=int(n_estimators), stepSize=float(learning_rate), maxDepth=int(max_depth),
                         subsamplingRate=float(subsample), minInstancesPerNode=int(min_samples_leaf),
                         maxBins=MAX_BINS, seed=SEED)


def _mlp(n, p, hidden=(50,), max_iter=1000, step_size=0.03):
    return MultilayerPerceptronClassifier(layers=[p, *[int(h) for h in hidden], 2], maxIter=int(max_iter),
                                          stepSize=float(step_size), solver="l-bfgs", seed=SEED)


def _bagging(n, p, n_estimators=100, max_samples=1.0, bootstrap=True):
    # unpruned trees over all features; 30 is the deepest Spark tree
    return RandomForestClassifier(numTrees=int(n_estimators), featureSubsetStrategy="all",
                                  bootstrap=bool(bootstrap), subsamplingRate=float(max_samples), maxDepth=30,
                                  maxBins=MAX_BINS, seed=SEED)


def _pasting(n, p, n_estimators=100, max_samples=1.0):
    return _bagging(n, p, n_estimators, max_samples, bootstrap=False)


def model(name: str, alias: str | None = None, **params) -> Classifier:
    """A classifier by its short name with manual-default parameters (overridable).

    ``alias`` renames the output columns (``{alias}_Prediction``), e.g. for a stacking meta model.
    """
    m = _model(name, **params)
    if alias:
        m.name = alias
    return m


def _model(name: str, **params) -> Classifier:
    if name == "Ridge":
        return SparkMLClassifier(name, _logistic, {"C": 1.0, "l1_ratio": 0.0, **params}, needs_n=True)
    if name == "Lasso":
        return SparkMLClassifier(name, _logistic, {"C": 1.0, "l1_ratio": 1.0, **params}, needs_n=True)
    if name == "ElasticNet":
        return SparkMLClassifier(name, _logistic, {"C": 1.0, "l1_ratio": 0.5, **params}, needs_n=True)
    if name == "DecisionTree":
        return SparkMLClassifier(name, _tree, dict(params))
    if name == "RandomForest":
        return StagedClassifier(name, _rf, dict(params))
    if name == "GBM":
        return StagedClassifier(name, _gbm, dict(params))
    if name == "MLP":
        return SparkMLClassifier(name, _mlp, dict(params))
    if name == "Bagging":
        return StagedClassifier(name, _bagging, dict(params))
    if name == "Pasting":
        return StagedClassifier(name, _pasting, dict(params))
    if name == "NB":
        return GaussianNB(name, **params)
    if name == "KNN":
        return KNNClassifier(name, **params)
    if name == "PLSDA":
        return PLSDA(name, **params)
    if name == "SVM":
        return SVMClassifier(name, **params)
    raise ValueError(f"unknown model {name!r}")


# The model short names (also the export prefixes).
MODEL_NAMES = ["Ridge", "Lasso", "ElasticNet", "PLSDA", "KNN", "NB", "SVM", "DecisionTree",
               "RandomForest", "GBM", "MLP", "Bagging", "Pasting", "Stacking", "Voting"]


def grid(name: str, n_features: int = 10) -> list[dict]:
    """The tuning search space at default slider ranges."""
    if name in ("Ridge", "Lasso"):
        return [{"C": c} for c in logspace(-1, math.log10(5), 10)]
    if name == "ElasticNet":
        return [{"C": c, "l1_ratio": r} for c in logspace(-1, math.log10(5), 5) for r in linspace(0.2, 0.8, 5)]
    if name == "PLSDA":
        return [{"n_components": k} for k in int_range(2, min(n_features, 10))]
    if name == "KNN":
        return [{"k": k, "weights": w, "metric": m} for k in int_range(3, 15)
                for w in ("uniform", "distance") for m in ("euclidean", "manhattan")]
    if name == "NB":
        return [{"var_smoothing": v} for v in logspace(-9, -6, 5)]
    if name == "SVM":
        return [{"C": c, "kernel": k} for c in linspace(0.1, 5, 3) for k in ("linear", "rbf")]
    if name == "DecisionTree":
        return [{"max_depth": d, "min_samples_leaf": l, "criterion": c} for d in int_range(3, 10)
                for l in int_range(1, 5) for c in ("gini", "entropy")]
    if name == "RandomForest":
        return [{"n_estimators": t, "max_depth": d, "min_samples_leaf": l} for t in int_range(50, 150, 10)
                for d in int_range(3, 10) for l in int_range(1, 5)]
    if name == "GBM":
        return [{"n_estimators": t, "learning_rate": r, "max_depth": d, "subsample": s, "min_samples_leaf": l}
                for t in int_range(50, 200, 10) for r in linspace(0.05, 0.3, 5) for d in int_range(2, 6)
                for s in linspace(0.5, 1.0, 5) for l in int_range(1, 5)]
    if name == "MLP":
        return [{"hidden": h} for h in ((32,), (64,), (128,), (64, 32), (128, 64))]
    if name == "Bagging":
        return [{"n_estimators": t, "max_samples": s} for t in int_range(50, 100, 10) for s in linspace(0.5, 1.0, 5)]
    if name == "Pasting":
        return [{"n_estimators": t, "max_samples": s} for t in int_range(50, 150, 10) for s in linspace(0.5, 1.0, 5)]
    raise ValueError(f"no grid for {name!r}")
