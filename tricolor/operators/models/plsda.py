"""PLS-DA: PLS1 regression on the 0/1 label, score thresholded at 0.5.

Only X'X and X'y of the standardised data are needed (Dayal & MacGregor 1997 kernel PLS):
one pass for means and sample stds, one pass for the p x p cross products; the p x p
iteration then runs on the driver. Scoring is a single dot-product expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.models.additive import FOLD, FoldFit, fold_scored, merged, product_moments
from tricolor.operators.models.base import Classifier, FittedClassifier, pred_col, prob_col
from tricolor.operators.profile import q


def kernel_pls1(xtx: np.ndarray, xty: np.ndarray, n_components: int) -> np.ndarray:
    """Regression coefficients (standardised space) of PLS1 from the cross-product matrices."""
    p = xtx.shape[0]
    xty = xty.astype(float).copy()
    R, P, Q = [], [], []
    for _ in range(min(n_components, p)):
        norm = np.linalg.norm(xty)
        if norm <= 1e-300:
            break
        w = xty / norm
        r = w.copy()
        for rj, pj in zip(R, P):
            r -= (pj @ w) * rj
        tt = float(r @ xtx @ r)
        if tt <= 1e-300:
            break
        pa = (xtx @ r) / tt
        qa = float(r @ xty) / tt
        xty = xty - pa * qa * tt
        R.append(r)
        P.append(pa)
        Q.append(qa)
    if not R:
        return np.zeros(p)
    return np.column_stack(R) @ np.array(Q)


@dataclass
class PLSDAFitted(FittedClassifier):
    name: str
    features: list[str]
    x_mean: list
    x_std: list
    y_mean: float
    y_std: float
    coef: list       # standardised-space coefficients

    def score(self):
        e = F.lit(self.y_mean)
        for f, m, s, b in zip(self.features, self.x_mean, self.x_std, self.coef):
            e = e + F.lit(self.y_std * b / s) * (q(f).cast("double") - F.lit(m))
        return e

    def predict(self, df: DataFrame) -> DataFrame:
        s = self.score()
        return df.select("*", (s >= 0.5).cast("int").alias(pred_col(self.name)), s.alias(prob_col(self.name)))

    def params(self) -> dict:
        return {"coef": self.coef}


@dataclass
class PLSDA(Classifier):
    name: str = "PLSDA"
    n_components: int = 2

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> PLSDAFitted:
        feats = list(features)
        at = product_moments(df.select(*[q(f) for f in feats], q(label), F.lit(0).alias(FOLD)), [*feats, label])
        if 0 not in at:
            raise ValueError("PLS-DA needs training rows")
        m = at[0]
        std = np.sqrt(np.diag(m.about) / max(1, m.n - 1))
        std = np.where(std > 0, std, 1.0)
        corr = m.about / np.outer(std, std)
        xtx, xty = corr[:-1, :-1], corr[:-1, -1]
        mx, sx = [float(v) for v in m.mean[:-1]], [float(v) for v in std[:-1]]
        my, sy = float(m.mean[-1]), float(std[-1])
        coef = kernel_pls1(xtx, xty, self.n_components)
        return PLSDAFitted(self.name, feats, mx, sx, my, sy, [float(b) for b in coef])

    def fold_scores(self, folded: DataFrame, features: Sequence[str], label: str, k: int, candidates: Sequence[dict]) -> DataFrame:
        """The rows once per candidate, with pred and prob (the score) by the fit without their fold."""
        at = product_moments(folded, [*features, label])
        fits = []
        for f in range(k):
            t = merged(m for g, m in at.items() if g != f)
            if t is None:
                raise ValueError("every fold needs rows outside of it")
            std = np.sqrt(np.diag(t.about) / max(t.n - 1, 1))
            std = np.where(std > 0, std, 1.0)
            z = t.about / np.outer(std, std)
            for i, params in enumerate(candidates):
                coef = kernel_pls1(z[:-1, :-1], z[:-1, -1], self.with_params(**params).n_components)
                fits.append(FoldFit(i, f, t.mean[-1], t.mean[:-1], coef * std[-1] / std[:-1]))
        scored = fold_scored(folded, fits, [q(c).cast("double") for c in features], 1)
        return scored.select("*", (F.col("_score") >= 0.5).cast("int").alias("pred")).withColumnRenamed("_score", "prob")

    def with_params(self, **params) -> "PLSDA":
        return PLSDA(self.name, int(params.get("n_components", self.n_components)))
