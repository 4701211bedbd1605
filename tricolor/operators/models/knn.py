"""k-nearest-neighbour classifier on the exact kNN join with pivots.

``fit`` keeps the training rows (id, feature vector, label); ``predict`` finds each row's
k nearest training rows, then votes: uniform = mean label; distance = 1/d-weighted mean,
where neighbours at distance 0 (if any) decide alone. Class 1 wins only above 0.5.

Cross-validation and grids need one search for each metric, not one fit for each fold and candidate:
a row's neighbours are looked for among the rows of other folds, for the largest ``k`` asked, and
every smaller ``k`` and either weighting is a prefix of that list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tricolor.operators.models.base import Classifier, FittedClassifier, pred_col, prob_col
from tricolor.operators.neighbors import DEFAULT_BLOCK_ROWS, knn
from tricolor.operators.profile import q


def _vote(weights: str, total, count) -> Column:
    """Share of class 1 among neighbours (dist, y); ``total`` and ``count`` sum a column and count a condition."""
    if weights == "uniform":
        return total(F.col("y")) / total(F.lit(1.0))
    zero = F.col("dist") == 0
    alone = total(F.when(zero, F.col("y"))) / count(zero)
    return F.when(count(zero) > 0, alone).otherwise(
        total(F.when(~zero, F.col("y") / F.col("dist"))) / total(F.when(~zero, 1.0 / F.col("dist"))))


@dataclass
class KNNFitted(FittedClassifier):
    name: str
    features: list[str]
    train: DataFrame           # (rid, rvec, y)
    k: int
    weights: str
    metric: str
    id_col: str
    block_rows: int

    def predict(self, df: DataFrame) -> DataFrame:
        qv = df.select(q(self.id_col).alias("qid"), F.array(*[q(f).cast("double") for f in self.features]).alias("qvec"))
        lab = knn(qv, self.train, self.k, "qid", "qvec", "rid", "rvec", metric=self.metric,
                  block_rows=self.block_rows, payload={"y": "double"})
        agg = lab.groupBy("qid").agg(_vote(self.weights, F.sum, F.count_if).alias("pw"))
        votes = agg.select(F.col("qid").alias(self.id_col), F.col("pw").cast("double").alias(prob_col(self.name)))
        votes = votes.select("*", (F.col(prob_col(self.name)) > 0.5).cast("int").alias(pred_col(self.name)))
        out = df.join(votes, self.id_col, "left")
        return out.select(*[q(c) for c in df.columns], pred_col(self.name), prob_col(self.name))


@dataclass
class KNNClassifier(Classifier):
    name: str = "KNN"
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    id_col: str = "row_id"
    block_rows: int = DEFAULT_BLOCK_ROWS

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> KNNFitted:
        feats = list(features)
        train = df.select(q(self.id_col).cast("bigint").alias("rid"),
                          F.array(*[q(f).cast("double") for f in feats]).alias("rvec"),
                          q(label).cast("double").alias("y"))
        return KNNFitted(self.name, feats, train, self.k, self.weights, self._metric(), self.id_col,
                         self.block_rows)

    def _metric(self) -> str:
        return "euclidean" if self.metric == "minkowski" else self.metric

    def fold_scores(self, folded: DataFrame, features: Sequence[str], label: str, k: int, candidates: Sequence[dict]) -> DataFrame:
        """The rows once per candidate, with pred and prob by the nearest rows of the other folds.

        A row without a neighbour (a missing feature, a single fold) has no score."""
        asked = [self.with_params(**c) for c in candidates]
        rows = folded.select(q(self.id_col).cast("bigint").alias("id"), F.array(*[q(f).cast("double") for f in features]).alias("vec"),
                             q(label).cast("double").alias("y"), F.col("fold"))
        votes = None
        for metric in sorted({c._metric() for c in asked}):
            at = [(i, c) for i, c in enumerate(asked) if c._metric() == metric]
            near = knn(rows, rows, max(c.k for _, c in at), "id", "vec", "id", "vec", metric=metric, block_rows=self.block_rows,
                       payload={"y": "double"}, exclude="fold")
            some = self._prefix_votes(near, at)
            votes = some if votes is None else votes.unionByName(some)
        votes = votes.groupBy("qid").agg(F.map_from_entries(F.flatten(F.collect_list("votes"))).alias("_votes"))
        out = folded.join(votes.withColumnRenamed("qid", self.id_col), self.id_col, "left")
        out = out.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(len(asked))])))
        prob = F.col("_votes")[F.col("candidate")]
        return out.select(*[q(c) for c in folded.columns], "candidate", (prob > 0.5).cast("int").alias("pred"), prob.alias("prob"))

    @staticmethod
    def _prefix_votes(near: DataFrame, asked: list[tuple[int, "KNNClassifier"]]) -> DataFrame:
        """(qid, votes): per row and rank the (candidate, prob) entries of the candidates that end there."""
        upto = Window.partitionBy("qid").orderBy("nn_rank").rowsBetween(Window.unboundedPreceding, 0)
        last = F.lead("nn_rank").over(Window.partitionBy("qid").orderBy("nn_rank")).isNull()
        kinds = sorted({c.weights for _, c in asked})
        running = near.select("qid", "nn_rank", last.alias("last"), *[
            _vote(w, lambda c: F.sum(c).over(upto), lambda c: F.count_if(c).over(upto)).alias(f"w_{w}") for w in kinds])
        ends = lambda c: (F.col("nn_rank") == c.k) | (F.col("last") & (F.col("nn_rank") < c.k))
        entries = F.array(*[F.when(ends(c), F.struct(F.lit(i).alias("candidate"), F.col(f"w_{c.weights}").alias("prob")))
                            for i, c in asked])
        return running.select("qid", F.filter(entries, lambda e: e.isNotNull()).alias("votes"))

    def with_params(self, **params) -> "KNNClassifier":
        return KNNClassifier(self.name, params.get("k", self.k), params.get("weights", self.weights),
                             params.get("metric", self.metric), self.id_col, self.block_rows)
