"""PCA on standardised features.

Standardise with the training mean and population std, then ``pyspark.ml.feature.PCA``
(a distributed p x p Gramian; only the p x p result reaches the driver). The sign of each
component is fixed so that its largest-|score| training row (ties: smallest row id) is
positive. Scores are applied as plain linear column expressions, so the fitted PCA replays on
any frame, batch or streaming.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tricolor.operators.profile import q
from tricolor.operators.transform import StandardScaling


@dataclass(frozen=True)
class PcaModel:
    features: tuple
    scaler: StandardScaling
    components: tuple      # p rows (features) x p columns (components)
    explained: tuple       # explained-variance ratio per component

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str], id_col: str = "row_id") -> "PcaModel":
        feats = list(features)
        scaler = StandardScaling.fit(df, feats)
        z = scaler.transform(df.select(q(id_col), *[q(c) for c in feats]))
        vec = VectorAssembler(inputCols=feats, outputCol="_tc_vec", handleInvalid="skip").transform(z)
        m = PCA(k=len(feats), inputCol="_tc_vec", outputCol="_tc_pc").fit(vec)
        pc = m.pc.toArray()                      # p x p
        ratio = m.explainedVariance.toArray()
        # sign: the largest-|score| row of each component is made positive; the scores come
        # from the fitted transform (one vector per row), so each aggregate stays small
        sc = m.transform(vec).select(q(id_col), vector_to_array(F.col("_tc_pc")).alias("_tc_s"))
        picks = sc.agg(*[F.max_by(F.col("_tc_s")[i], F.struct(F.abs(F.col("_tc_s")[i]), -q(id_col))).alias(f"s{i}")
                         for i in range(len(feats))]).first()
        signs = np.array([(-1.0 if (picks[f"s{i}"] or 0.0) < 0 else 1.0) for i in range(len(feats))])
        pc = pc * signs[None, :]
        return PcaModel(tuple(feats), scaler, tuple(map(tuple, pc.tolist())), tuple(float(r) for r in ratio))

    def score_exprs(self, k: int) -> list[Column]:
        z = self.scaler.exprs()
        pc = np.array(self.components)
        out = []
        for i in range(k):
            e = None
            for j, c in enumerate(self.features):
                term = F.lit(float(pc[j, i])) * z[c]
                e = term if e is None else e + term
            out.append(e.alias(f"PC{i + 1}"))
        return out

    def transform(self, df: DataFrame, k: int, keep: Sequence[str] = ("row_id",)) -> DataFrame:
        """Keep ``keep`` columns (ids, label) and the first ``k`` component scores."""
        if not 1 <= k <= len(self.features):
            raise ValueError(f"k must lie in [1, {len(self.features)}]")
        return df.select(*[q(c) for c in keep if c in df.columns], *self.score_exprs(k))

    def variance(self, spark: SparkSession) -> DataFrame:
        """(pc, explained_ratio, cumulative) with the running sum as a window over p rows."""
        rows = [(i + 1, float(r)) for i, r in enumerate(self.explained)]
        v = spark.createDataFrame(rows, "pc int, explained_ratio double")
        w = Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)
        return v.select("pc", "explained_ratio", F.sum("explained_ratio").over(w).alias("cumulative"))

    def loadings(self, spark: SparkSession, digits: int = 4) -> DataFrame:
        """Long table (feature, pc, loading) rounded to ``digits``."""
        pc = np.array(self.components)
        rows = [(c, i + 1, round(float(pc[j, i]), digits)) for j, c in enumerate(self.features)
                for i in range(len(self.features))]
        return spark.createDataFrame(rows, "feature string, pc int, loading double")
