"""Stacking and soft voting over already-defined classifiers.

Stacking: out-of-fold class-1 probabilities of every base model (stratified md5 folds) are
the meta model's features; the bases are then refit on all training rows. Voting: the mean
of the members' class-1 probabilities; class 1 only above 0.5.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.models.base import Classifier, FittedClassifier, pred_col, prob_col
from tricolor.operators.models.plsda import PLSDA
from tricolor.operators.profile import q
from tricolor.session import cut_lineage

SEED = 42


@dataclass
class StackingFitted(FittedClassifier):
    name: str
    features: list[str]
    bases: list[FittedClassifier]
    meta: FittedClassifier

    def predict(self, df: DataFrame) -> DataFrame:
        x = df
        for b in self.bases:
            x = b.predict(x)
        x = self.meta.predict(x)
        return x.select(*[q(c) for c in df.columns], F.col(pred_col(self.meta.name)).alias(pred_col(self.name)),
                        F.col(prob_col(self.meta.name)).alias(prob_col(self.name)))


@dataclass
class Stacking(Classifier):
    name: str = "Stacking"
    bases: list[Classifier] = field(default_factory=list)
    meta: Classifier | None = None
    folds: int = 5
    id_col: str = "row_id"

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> StackingFitted:
        from tricolor.operators.models.catalog import model
        from tricolor.operators.sampling import stratified_folds
        if len(self.bases) < 2:
            raise ValueError("stacking needs at least two base models")
        # a continuous PLS-DA score and a vote of other models are not stacked
        refused = [b.name for b in self.bases if isinstance(b, (PLSDA, Voting))]
        if refused:
            raise ValueError(f"stacking does not take {refused} as base models")
        feats = list(features)
        folded = stratified_folds(df.select(q(self.id_col), *[q(f) for f in feats], q(label)), label,
                                  self.folds, SEED, self.id_col)
        oof = None
        for f in range(self.folds):
            train = folded.where(F.col("fold") != f)
            held = folded.where(F.col("fold") == f)
            for b in self.bases:
                held = b.fit(train, feats, label).predict(held)
            part = held.select(q(self.id_col), q(label), *[F.col(prob_col(b.name)) for b in self.bases])
            oof = part if oof is None else oof.unionByName(part)
        oof = cut_lineage(oof)  # read by the count and by every iteration of the meta fit
        meta = self.meta or model("Ridge", alias=f"{self.name}Meta")
        meta_fit = meta.fit(oof, [prob_col(b.name) for b in self.bases], label)
        bases = [b.fit(df, feats, label) for b in self.bases]
        return StackingFitted(self.name, feats, bases, meta_fit)


@dataclass
class VotingFitted(FittedClassifier):
    name: str
    features: list[str]
    members: list[FittedClassifier]

    def predict(self, df: DataFrame) -> DataFrame:
        x = df
        for m in self.members:
            x = m.predict(x)
        mean = sum(F.col(prob_col(m.name)) for m in self.members) / F.lit(float(len(self.members)))
        return x.select(*[q(c) for c in df.columns], (mean > 0.5).cast("int").alias(pred_col(self.name)),
                        mean.alias(prob_col(self.name)))


@dataclass
class Voting(Classifier):
    name: str = "Voting"
    members: list[Classifier] = field(default_factory=list)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> VotingFitted:
        if len(self.members) < 2:
            raise ValueError("voting needs at least two models")
        return VotingFitted(self.name, list(features), [m.fit(df, features, label) for m in self.members])

    @staticmethod
    def of_fitted(name: str, members: Sequence[FittedClassifier]) -> VotingFitted:
        return VotingFitted(name, list(members[0].features), list(members))
