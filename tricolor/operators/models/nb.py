"""Gaussian naive Bayes with variance smoothing.

Fit = one grouped aggregate (count, mean, population variance per class and feature) plus
one overall variance aggregate; smoothing adds ``var_smoothing * max_j var(x_j)`` to every
class variance. Prediction is a closed-form log-likelihood expression (no UDF).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.operators.models.additive import FoldFit, class_moments, fold_scored, merged
from tricolor.operators.models.base import Classifier, FittedClassifier, pred_col, prob_col
from tricolor.operators.profile import q


@dataclass
class GaussianNBFitted(FittedClassifier):
    name: str
    features: list[str]
    priors: dict
    means: dict
    variances: dict

    def _jll(self, c) -> Column:
        e = F.lit(math.log(self.priors[c]))
        for j, f in enumerate(self.features):
            m, v = self.means[c][j], self.variances[c][j]
            e = e - F.lit(0.5 * math.log(2.0 * math.pi * v)) - (q(f).cast("double") - F.lit(m)) ** 2 / F.lit(2.0 * v)
        return e

    def predict(self, df: DataFrame) -> DataFrame:
        d = self._jll(0) - self._jll(1)
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(d))
        return df.select("*", (d < 0).cast("int").alias(pred_col(self.name)), prob.alias(prob_col(self.name)))

    def params(self) -> dict:
        return {"priors": self.priors}


@dataclass
class GaussianNB(Classifier):
    name: str = "NB"
    var_smoothing: float = 1e-9

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> GaussianNBFitted:
        feats = list(features)
        x = [q(f).cast("double") for f in feats]
        per = df.groupBy(q(label).alias("_c")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(e).alias(f"m{j}") for j, e in enumerate(x)],
            *[F.var_pop(e).alias(f"v{j}") for j, e in enumerate(x)]).collect()
        overall = df.agg(*[F.var_pop(e).alias(f"v{j}") for j, e in enumerate(x)]).first()
        eps = self.var_smoothing * max(float(overall[f"v{j}"] or 0.0) for j in range(len(feats)))
        eps = eps if eps > 0 else self.var_smoothing
        total = sum(r["_n"] for r in per)
        priors, means, variances = {}, {}, {}
        for r in per:
            c = int(r["_c"])
            priors[c] = r["_n"] / total
            means[c] = [float(r[f"m{j}"]) for j in range(len(feats))]
            variances[c] = [float(r[f"v{j}"] or 0.0) + eps for j in range(len(feats))]
        if set(priors) != {0, 1}:
            raise ValueError("naive Bayes needs both classes 0 and 1 in the training data")
        return GaussianNBFitted(self.name, feats, priors, means, variances)

    def fit_bags(self, rows: DataFrame, features: Sequence[str], label: str, names: Sequence[str]) -> list[GaussianNBFitted]:
        """One fit for every bag (numbered in ``fold``), all from one aggregate."""
        at = class_moments(rows, features, label)
        out = []
        for t, name in enumerate(names):
            per = [at.get((t, c)) for c in (0, 1)]
            if None in per:
                raise ValueError("naive Bayes needs both classes 0 and 1 in every bag")
            whole = per[0].plus(per[1])
            eps = self.var_smoothing * float((whole.about / whole.n).max()) or self.var_smoothing
            out.append(GaussianNBFitted(name, list(features), {c: m.n / whole.n for c, m in enumerate(per)},
                                        {c: m.mean.tolist() for c, m in enumerate(per)},
                                        {c: (m.about / m.n + eps).tolist() for c, m in enumerate(per)}))
        return out

    def fold_scores(self, folded: DataFrame, features: Sequence[str], label: str, k: int, candidates: Sequence[dict]) -> DataFrame:
        """The rows once per candidate, with pred and prob by the fit without their fold."""
        at = class_moments(folded, features, label)
        fits = []
        for f in range(k):
            train = [merged(m for (g, y), m in at.items() if g != f and y == c) for c in (0, 1)]
            if None in train:
                raise ValueError("naive Bayes needs both classes 0 and 1 in the training data")
            whole = train[0].plus(train[1])
            for i, params in enumerate(candidates):
                smoothing = self.with_params(**params).var_smoothing
                eps = smoothing * float((whole.about / whole.n).max()) or smoothing
                v0, v1 = (t.about / t.n + eps for t in train)
                start = math.log(train[0].n / train[1].n) - 0.5 * float(np.log(v0 / v1).sum())
                fits.append(FoldFit(i, f, start, [*train[0].mean, *train[1].mean], [*(-0.5 / v0), *(0.5 / v1)]))
        x = [q(c).cast("double") for c in features]
        d = F.col("_score")
        return fold_scored(folded, fits, x + x, 2).select(
            "*", (d < 0).cast("int").alias("pred"), (F.lit(1.0) / (F.lit(1.0) + F.exp(d))).alias("prob")).drop("_score")

    def with_params(self, **params) -> "GaussianNB":
        return GaussianNB(self.name, params.get("var_smoothing", self.var_smoothing))
