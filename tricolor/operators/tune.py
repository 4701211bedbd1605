"""Cross-validation, grid and random search, pooled out-of-fold predictions.

Folds are md5-stratified (``fold`` column). For each candidate every fold's held-out rows are
scored and the k fold results are reduced in one grouped metrics job; only the k x 5 metric
table reaches the driver. Learners whose statistics add up over folds (naive Bayes, PLS-DA) are not
fitted per fold: one grouped aggregate serves all folds and candidates. Other candidates may run in parallel driver threads (Spark schedules
their jobs concurrently), as ``CrossValidator(parallelism=...)`` does.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.metrics import auc, binary_metrics
from tricolor.operators.models.base import Classifier, FittedClassifier, pred_col, prob_col
from tricolor.operators.profile import q
from tricolor.operators.sampling import plain_folds, stratified_folds
from tricolor.session import cut_lineage

SEED = 42
METRICS = ["accuracy", "precision", "recall", "f1", "auc"]


def add_folds(df: DataFrame, label: str, k: int, stratified: bool = True, seed: int = SEED,
              id_col: str = "row_id") -> DataFrame:
    return stratified_folds(df, label, k, seed, id_col) if stratified else plain_folds(df, k, seed, id_col)


def candidate_scores(clf: Classifier, cands: Sequence[dict], folded: DataFrame, features: Sequence[str], label: str, k: int,
                     id_col: str = "row_id") -> DataFrame:
    """(candidate, row_id, fold, label, pred, prob): every candidate, each row by the fit without its
    fold, for learners whose statistics add up over folds: one aggregate, one join with the fits."""
    scored = clf.fold_scores(folded, features, label, k, cands)
    return scored.select("candidate", q(id_col), "fold", q(label), "pred", "prob")


def out_of_fold(clf: Classifier, folded: DataFrame, features: Sequence[str], label: str, k: int,
                id_col: str = "row_id") -> DataFrame:
    """(row_id, fold, label, pred, prob) for every row, each scored by the model not trained on it."""
    if hasattr(clf, "fold_scores"):
        return candidate_scores(clf, [{}], folded, features, label, k, id_col).drop("candidate")
    parts = None
    for f in range(k):
        fitted = clf.fit(folded.where(F.col("fold") != f), features, label)
        held = fitted.predict(folded.where(F.col("fold") == f))
        part = held.select(q(id_col), "fold", q(label), F.col(pred_col(clf.name)).alias("pred"),
                           F.col(prob_col(clf.name)).alias("prob"))
        parts = part if parts is None else parts.unionByName(part)
    # materialise once: the metrics read it twice and the k fits must not be replayed
    return cut_lineage(parts)


def fold_metrics(clf: Classifier, folded: DataFrame, features: Sequence[str], label: str, k: int,
                 id_col: str = "row_id") -> DataFrame:
    """One row of metrics per fold."""
    return binary_metrics(out_of_fold(clf, folded, features, label, k, id_col), label, "pred", "prob", ["fold"])


def cv_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population std of each metric over folds (long form)."""
    long = per_fold.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("e"))
    return long.groupBy("e.metric").agg(F.avg("e.value").alias("mean"), F.stddev_pop("e.value").alias("std"))


def pooled_metrics(clf: Classifier, folded: DataFrame, features: Sequence[str], label: str, k: int,
                   id_col: str = "row_id") -> DataFrame:
    """Out-of-fold predictions pooled first, metrics computed once (the PLS-DA way)."""
    return binary_metrics(out_of_fold(clf, folded, features, label, k, id_col), label, "pred", "prob")


def candidates(grid: list[dict], search: str = "grid", n_iter: int = 10, seed: int = SEED) -> list[dict]:
    """The whole grid, or a seeded sample of ``n_iter`` of its points (random search)."""
    if search == "grid":
        return list(grid)
    if search == "random":
        if n_iter >= len(grid):
            return list(grid)
        idx = sorted(random.Random(seed).sample(range(len(grid)), n_iter))
        return [grid[i] for i in idx]
    raise ValueError("search must be 'grid' or 'random'")


def search_cv(clf: Classifier, grid: list[dict], df: DataFrame, features: Sequence[str], label: str,
              k: int = 10, search: str = "grid", n_iter: int = 10, seed: int = SEED, stratified: bool = True,
              parallelism: int = 1, id_col: str = "row_id") -> tuple[dict, list[tuple[dict, float]], FittedClassifier]:
    """Mean CV AUC per candidate; the first best candidate is refit on all rows."""
    folded = add_folds(df.select(q(id_col), *[q(f) for f in features], q(label)), label, k, stratified, seed, id_col)
    cands = candidates(grid, search, n_iter, seed)

    def by_candidate() -> list[float]:
        scores = candidate_scores(clf, cands, folded, features, label, k, id_col)
        per = auc(scores, label, "prob", ["candidate", "fold"]).groupBy("candidate").agg(F.avg("auc").alias("auc")).collect()
        found = {r["candidate"]: r["auc"] for r in per}
        return [float(found[i]) if found.get(i) is not None else float("-inf") for i in range(len(cands))]

    def score(params: dict) -> float:
        m = fold_metrics(clf.with_params(**params), folded, features, label, k, id_col)
        r = m.agg(F.avg("auc").alias("auc")).first()
        return float(r["auc"]) if r["auc"] is not None else float("-inf")

    if hasattr(clf, "fold_scores"):
        scores = by_candidate()
    elif parallelism > 1:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(score, cands))
    else:
        scores = [score(c) for c in cands]
    results = list(zip(cands, scores))
    best_i = max(range(len(results)), key=lambda i: (results[i][1], -i))
    best = cands[best_i]
    return best, results, clf.with_params(**best).fit(df, features, label)
