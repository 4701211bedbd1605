"""Bagging and pasting of any learner by hash-derived draws.

How often a row is drawn into a bag is a function of the seed, the bag and the row's id alone, so a bag
is the same on any partitioning and no rows are exchanged to draw it:

* bagging: the number of draws is Poisson(``max_samples``), read off a uniform hash (the bootstrap's limit
  for many rows; a bag holds about ``max_samples`` x n rows, drawn with replacement);
* pasting: exactly ``floor(max_samples * n)`` rows with the smallest hashes, found by counting for all bags
  together (``operators.cutoff``).

Learners whose statistics add up (naive Bayes) fit all bags from one aggregate; others are fitted bag by bag.
The prediction is the mean of the bags' class-1 probabilities; class 1 only above 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.functions.hashing import TWO_POW_32, hash_key, hash_uniform
from tricolor.operators.cutoff import class_cutoffs
from tricolor.operators.models.additive import FOLD
from tricolor.operators.models.base import Classifier
from tricolor.operators.models.ensemble import VotingFitted
from tricolor.operators.models.nb import GaussianNB
from tricolor.operators.profile import q

SEED = 42


def poisson_steps(rate: float) -> list[float]:
    """P(draws <= k) for k = 0, 1, ... as long as a hash of 32 bits can lie above it."""
    term = total = math.exp(-rate)
    out = []
    while total < 1.0 - 1.0 / TWO_POW_32 and term > 0:
        out.append(total)
        term *= rate / (len(out))
        total += term
    return [*out, total] if total < 1.0 else out


def _bag_key(id_: Column) -> Column:
    return F.concat(F.col(FOLD).cast("string"), F.lit(":"), id_.cast("string"))


def draws(df: DataFrame, bags: int, max_samples: float, bootstrap: bool, seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """The rows of every bag, its number in ``fold``; with ``bootstrap`` a row is there as often as it was drawn."""
    spread = df.withColumn(FOLD, F.explode(F.array(*[F.lit(t) for t in range(bags)])))
    if bootstrap:
        u = hash_uniform(f"{seed}:bag", _bag_key(q(id_col)))
        times = F.lit(0)
        for step in poisson_steps(max_samples):
            times = times + (u >= F.lit(step)).cast("int")
        return spread.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where(F.col("_copy") > 0).drop("_copy")
    key = hash_key(f"{seed}:paste", _bag_key(q(id_col)))
    _, cuts = class_cutoffs(spread, key, q(id_col), F.col(FOLD), lambda n: {t: int(max_samples * c) for t, c in n.items()})
    keep = F.lit(False)
    for t, cut in cuts.items():
        keep = keep | ((F.col(FOLD) == t) & cut.holds(key, q(id_col)))
    return spread.where(keep)


@dataclass
class HashBagging(Classifier):
    """``n_estimators`` fits of ``base`` on hash-drawn samples of ``max_samples`` of the rows."""

    name: str = "Bagged"
    base: Classifier = field(default_factory=GaussianNB)
    n_estimators: int = 10
    max_samples: float = 1.0
    bootstrap: bool = True
    id_col: str = "row_id"
    seed: int = SEED

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> VotingFitted:
        if self.n_estimators < 1 or not 0 < self.max_samples <= 1:
            raise ValueError("bagging needs at least one bag and a share of the rows in (0, 1]")
        feats = list(features)
        rows = draws(df.select(q(self.id_col), *[q(f) for f in feats], q(label)), self.n_estimators, self.max_samples,
                     self.bootstrap, self.seed, self.id_col)
        names = [f"{self.name}_{t}" for t in range(self.n_estimators)]
        if hasattr(self.base, "fit_bags"):
            members = self.base.fit_bags(rows, feats, label, names)
        else:
            members = [replace(self.base, name=name).fit(rows.where(F.col(FOLD) == t).drop(FOLD), feats, label)
                       for t, name in enumerate(names)]
        return VotingFitted(self.name, feats, members)

    def with_params(self, **params) -> "HashBagging":
        own = {n: v for n, v in params.items() if n in ("n_estimators", "max_samples", "bootstrap")}
        rest = {n: v for n, v in params.items() if n not in own}
        return replace(self, base=self.base.with_params(**rest) if rest else self.base, **own)
