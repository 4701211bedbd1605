"""Fold-additive statistics: what a model needs of every training part, from one aggregate.

Rows are counted once, grouped by fold and class: number, means, and sums of squares or products
about the means. These add up over groups without cancellation (``merged``), so the training part
of a fold is the merge of all other folds. The fits of all folds then run on the driver from
folds x classes rows, and every row is scored by the fit of its own fold: the constants of all folds
and candidates are a small relation, joined on the fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.operators.gram import group_products
from tricolor.operators.profile import NATIVE_PAIRED, q

FOLD = "fold"


@dataclass
class Moments:
    """Number of rows, means, and sums of squares (p) or of products (p x p) about the means."""

    n: int
    mean: np.ndarray
    about: np.ndarray

    def plus(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        gap = other.mean - self.mean
        spread = gap * gap if self.about.ndim == 1 else np.outer(gap, gap)
        return Moments(n, self.mean + gap * (other.n / n), self.about + other.about + spread * (self.n * other.n / n))


def merged(parts: Iterable[Moments]) -> Moments | None:
    out = None
    for m in parts:
        out = m if out is None else out.plus(m)
    return out


def class_moments(folded: DataFrame, features: Sequence[str], label: str) -> dict[tuple[int, int], Moments]:
    """(fold, class) -> moments of the features; folds x 2 rows reach the driver."""
    x = [q(f).cast("double") for f in features]
    rows = folded.groupBy(F.col(FOLD).alias("f"), q(label).cast("int").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(e) for e in x]).alias("m"), F.array(*[F.var_pop(e) for e in x]).alias("v")).collect()
    return {(r["f"], r["c"]): Moments(r["n"], np.array(r["m"], float), np.array(r["v"], float) * r["n"]) for r in rows}


def product_moments(folded: DataFrame, columns: Sequence[str]) -> dict[int, Moments]:
    """fold -> moments with all products of ``columns`` (without NULLs); one row per fold reaches the driver."""
    if len(columns) > NATIVE_PAIRED:
        return {g: Moments(*m) for g, m in group_products(folded, columns, FOLD).items()}
    x = [q(c).cast("double") for c in columns]
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out = {}
    for r in folded.groupBy(F.col(FOLD).alias("f")).agg(
            F.count(F.lit(1)).alias("n"), F.array(*[F.avg(e) for e in x]).alias("m"),
            F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("c")).collect():
        about = np.zeros((p, p))
        for (i, j), c in zip(pairs, r["c"]):
            about[i, j] = about[j, i] = c * r["n"]
        out[r["f"]] = Moments(r["n"], np.array(r["m"], float), about)
    return out


@dataclass
class FoldFit:
    """One candidate fitted without one fold: ``start`` + sum of coef * (x - centre) ** power."""

    candidate: int
    fold: int
    start: float
    centre: Sequence[float]
    coef: Sequence[float]


def fold_scored(folded: DataFrame, fits: Sequence[FoldFit], x: Sequence[Column], power: int) -> DataFrame:
    """The rows once per candidate, with ``candidate`` and ``_score`` by the fit of their own fold.

    The fits (folds x candidates rows of p numbers) are a relation that is joined on the fold."""
    rows = [(f.candidate, f.fold, float(f.start), [float(c) for c in f.centre], [float(c) for c in f.coef]) for f in fits]
    table = folded.sparkSession.createDataFrame(
        rows, f"candidate int, {FOLD} int, _start double, _centre array<double>, _coef array<double>")
    gap = F.zip_with(F.array(*x), F.col("_centre"), lambda v, c: v - c)
    term = F.zip_with(gap, F.col("_coef"), (lambda g, c: c * g * g) if power == 2 else (lambda g, c: c * g))
    score = F.aggregate(term, F.col("_start"), lambda total, t: total + t)
    joined = folded.join(F.broadcast(table), FOLD)
    return joined.select(*[q(c) for c in folded.columns], "candidate", score.alias("_score"))
