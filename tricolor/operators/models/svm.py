"""Support vector classifier with Platt-scaled probabilities.

* linear kernel: ``LinearSVC(regParam = 1 / (C * n))`` on the features;
* rbf kernel: random Fourier features (Rahimi & Recht 2007), ``sqrt(2/D) cos(W x + b)`` with
  ``W ~ N(0, 2 gamma)``, as column expressions, then the same linear SVC;
  ``gamma = "scale"`` is ``1 / (p * Var(X))`` over all feature values;
* poly kernel (degree 3, coef0 = 0): the exact finite feature map of ``(gamma x.y)^3``
  (scaled degree-3 monomials) - no approximation;
* probability: Platt (1999) - a 1-D logistic fit on out-of-fold margins (plain md5 folds).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.models.base import (VEC, Classifier, FittedClassifier, assemble, pred_col, prob_col)
from tricolor.operators.profile import q
from tricolor.session import cut_lineage

SEED = 42
# Fits that keep their vectors in memory at the same time.
FITS_AT_ONCE = 3


@dataclass
class _Expansion:
    features: list[str]
    W: list | None = None      # D x p
    b: list | None = None
    poly: list | None = None   # [(scale, (i, j, k)), ...] for the exact degree-3 map

    def columns(self):
        if self.poly is not None:
            out = []
            for n, (scale, idx) in enumerate(self.poly):
                e = F.lit(scale)
                for j in idx:
                    e = e * q(self.features[j]).cast("double")
                out.append(e.alias(f"_tc_x{n}"))
            return out
        if self.W is None:
            return [q(f).cast("double").alias(f"_tc_x{j}") for j, f in enumerate(self.features)]
        D = len(self.W)
        scale = math.sqrt(2.0 / D)
        out = []
        for i in range(D):
            e = F.lit(self.b[i])
            for j, f in enumerate(self.features):
                e = e + F.lit(self.W[i][j]) * q(f).cast("double")
            out.append((F.lit(scale) * F.cos(e)).alias(f"_tc_x{i}"))
        return out

    def names(self):
        if self.poly is not None:
            n = len(self.poly)
        else:
            n = len(self.features) if self.W is None else len(self.W)
        return [f"_tc_x{i}" for i in range(n)]


def poly3_map(p: int, gamma: float) -> list:
    """Exact feature map of (gamma x.y)^3: every degree-3 monomial x_i x_j x_k (i <= j <= k)
    scaled by sqrt(gamma^3 * 3! / (multiplicities!)), so inner products equal the kernel."""
    out = []
    for idx in itertools.combinations_with_replacement(range(p), 3):
        mult = 1
        for v in set(idx):
            mult *= math.factorial(idx.count(v))
        out.append((math.sqrt(gamma ** 3 * 6.0 / mult), idx))
    return out


@dataclass
class SVMFitted(FittedClassifier):
    name: str
    features: list[str]
    expansion: _Expansion
    model: object
    platt_a: float
    platt_b: float

    def margin_frame(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        x = df.select("*", *self.expansion.columns())
        out = self.model.transform(assemble(x, self.expansion.names()))
        return out.select(*[q(c) for c in keep], vector_to_array(F.col("rawPrediction"))[1].alias("_tc_margin"))

    def predict(self, df: DataFrame) -> DataFrame:
        m = self.margin_frame(df)
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.platt_a) * F.col("_tc_margin") + F.lit(self.platt_b))))
        return m.select(*[q(c) for c in df.columns], (F.col("_tc_margin") > 0).cast("int").alias(pred_col(self.name)),
                        prob.alias(prob_col(self.name)))


@dataclass
class SVMClassifier(Classifier):
    name: str = "SVM"
    C: float = 1.0
    kernel: str = "rbf"
    gamma: float | str = "scale"
    n_components: int = 100
    platt_folds: int = 5
    max_iter: int = 100
    id_col: str = "row_id"

    def _fit_svc(self, x: DataFrame, names, label: str, n: int):
        svc = LinearSVC(regParam=1.0 / (self.C * n), maxIter=self.max_iter, featuresCol=VEC, labelCol=label)
        # the estimator keeps its own blocks of the vectors: a second copy beside them would push them to disk
        return svc.fit(assemble(x.select(*names, F.col(label).cast("double").alias(label)), names).select(VEC, label))

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> SVMFitted:
        from tricolor.operators.sampling import plain_folds
        feats = list(features)
        p = len(feats)
        # read some twenty times below: the preparation of the rows must not be replayed for each
        df = cut_lineage(df.select(q(self.id_col), *[q(f) for f in feats], q(label)))
        gamma = self.gamma
        if gamma == "auto":
            gamma = 1.0 / p
        if gamma == "scale" and self.kernel in ("rbf", "poly"):
            r = df.agg(*[F.avg(q(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                       *[F.avg(q(f).cast("double") ** 2).alias(f"s{j}") for j, f in enumerate(feats)]).first()
            ex = sum(r[f"m{j}"] for j in range(p)) / p
            ex2 = sum(r[f"s{j}"] for j in range(p)) / p
            var = ex2 - ex * ex
            gamma = 1.0 / (p * var) if var > 0 else 1.0
        if self.kernel == "linear":
            exp = _Expansion(feats)
        elif self.kernel == "poly":
            exp = _Expansion(feats, poly=poly3_map(p, float(gamma)))
        elif self.kernel == "rbf":
            rng = np.random.default_rng(SEED)
            W = rng.normal(0.0, math.sqrt(2.0 * float(gamma)), size=(self.n_components, p))
            b = rng.uniform(0.0, 2.0 * math.pi, size=self.n_components)
            exp = _Expansion(feats, W.tolist(), b.tolist())
        else:
            raise ValueError(f"unsupported kernel {self.kernel!r} (linear, rbf, poly)")
        n = df.count()
        # Platt scaling on out-of-fold margins
        folded = plain_folds(df, self.platt_folds, SEED, self.id_col)
        # narrow rows come in few partitions; once expanded they should keep every core busy
        folded = cut_lineage(folded.repartition(df.sparkSession.sparkContext.defaultParallelism, q(self.id_col)))
        wide = folded.select("*", *exp.columns())
        # the folds' fits and the last one, over all rows, do not need each other
        parts = [wide.where(F.col("fold") != f) for f in range(self.platt_folds)]
        with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
            *of_folds, model = pool.map(lambda x: self._fit_svc(x, exp.names(), label, n), [*parts, wide])
        oof = None
        for f, m in enumerate(of_folds):
            fitted = SVMFitted(self.name, feats, exp, m, 1.0, 0.0)
            part = fitted.margin_frame(folded.where(F.col("fold") == f).drop("fold"))
            part = part.select("_tc_margin", q(label).cast("double").alias("_tc_y"))
            oof = part if oof is None else oof.unionByName(part)
        oof = cut_lineage(oof)
        # Platt (1999): smoothed targets, as two weighted rows per margin
        n1 = df.agg(F.count_if(q(label) == 1)).first()[0]
        n0 = n - n1
        hi, lo = (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0)
        share = F.when(F.col("_tc_y") == 1, F.lit(hi)).otherwise(F.lit(lo))
        soft = oof.select("_tc_margin", F.explode(F.array(
            F.struct(F.lit(1.0).alias("t"), share.alias("w")),
            F.struct(F.lit(0.0).alias("t"), (F.lit(1.0) - share).alias("w")))).alias("e")).select("_tc_margin", "e.t", "e.w")
        lr = LogisticRegression(featuresCol="_tc_mv", labelCol="t", weightCol="w", regParam=0.0, maxIter=100)
        pm = lr.fit(assemble(soft, ["_tc_margin"], "_tc_mv"))
        a, b0 = float(pm.coefficients[0]), float(pm.intercept)
        return SVMFitted(self.name, feats, exp, model, a, b0)

    def with_params(self, **params) -> "SVMClassifier":
        return SVMClassifier(self.name, float(params.get("C", self.C)), params.get("kernel", self.kernel),
                             params.get("gamma", self.gamma), self.n_components, self.platt_folds,
                             self.max_iter, self.id_col)
