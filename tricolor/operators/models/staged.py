"""Staged ensembles: one fit answers for every smaller number of trees.

The trees of an ensemble are added one after the other, so the votes of the first m trees are the
ensemble of size m. A grid over the number of trees is therefore one fit at the largest number for each
setting of the other parameters; the running sums of the trees' votes give all smaller ones in one pass
over the rows. Boosted trees of a smaller fit are exactly the first ones of a larger one; a forest's trees
are independent draws, so its first m are a forest of m trees (drawn otherwise than by a fit of m).

The nodes of all trees are a small table (as large as the model itself, which the driver holds anyhow);
tasks walk the rows of an Arrow batch down all trees with numpy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.models.base import SparkMLClassifier
from tricolor.operators.profile import q
from tricolor.session import cut_lineage, scratch_path, ship_package

COUNT = "n_estimators"


@dataclass
class Tree:
    """Nodes by id: feature (-1 in a leaf), threshold, children and the vote of a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    vote: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            node = at[going]
            # a missing value goes right, as in Spark's own comparison
            low = x[going, self.feature[node]] <= self.threshold[node]
            at[going] = np.where(low, self.left[node], self.right[node])
            going = going[self.feature[at[going]] >= 0]
        return self.vote[at]


def _trees(spark, model) -> list[Tree]:
    """The trees of a fitted Spark ensemble in their order; votes are class-1 shares, or weighted gains if boosted."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("gain"), node["impurityStats"].alias("stats"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        node["split"]["numCategories"].alias("categories")).toPandas()
    if (rows["categories"] >= 0).any():
        raise ValueError("staged ensembles take continuous features only")
    boosted = "GBT" in type(model).__name__
    out = []
    for t, nodes in rows.sort_values(["treeID", "id"]).groupby("treeID"):
        if boosted:
            vote = nodes["gain"].to_numpy(float) * model.treeWeights[t]
        else:
            vote = np.array([s[1] / sum(s) for s in nodes["stats"]], float)
        out.append(Tree(np.where(nodes["left"] < 0, -1, nodes["feature"]).astype(np.int64), nodes["threshold"].to_numpy(float),
                        nodes["left"].to_numpy(np.int64), nodes["right"].to_numpy(np.int64), vote))
    return out


def staged_scores(model, rows: DataFrame, keep: Sequence[str], features: Sequence[str], counts: Sequence[int]) -> DataFrame:
    """(*keep, _at, pred, prob): every row once for each number of trees, ``_at`` being its place in ``counts``.

    Fewer trees than asked for (boosting that stopped early) count as all of them."""
    ship_package(rows.sparkSession)
    trees = _trees(rows.sparkSession, model)
    boosted = "GBT" in type(model).__name__
    sizes = np.minimum(np.array(counts), len(trees))
    x = F.array(*[F.coalesce(q(f).cast("double"), F.lit(float("nan"))) for f in features])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            m = np.stack(b["_x"].to_numpy())
            total, kept, wanted = np.zeros(len(m)), {}, set(sizes.tolist())
            for i, tree in enumerate(trees, 1):
                total = total + tree.votes(m)
                if i in wanted:
                    kept[i] = total
            for at, size in enumerate(sizes.tolist()):
                got = b.drop(columns="_x")
                got["_at"] = at
                with np.errstate(over="ignore"):
                    got["prob"] = 1 / (1 + np.exp(-2 * kept[size])) if boosted else kept[size] / size
                got["pred"] = (kept[size] > 0 if boosted else got["prob"] > 0.5).astype("int32")
                yield got[[*keep, "_at", "pred", "prob"]]

    source = rows.select(*[q(c) for c in keep], x.alias("_x"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_x")
    return source.mapInPandas(run, f"{types}, _at int, pred int, prob double")


@dataclass
class StagedClassifier(SparkMLClassifier):
    """A tree ensemble whose number of trees is the parameter ``n_estimators``."""

    def fold_scores(self, folded: DataFrame, features: Sequence[str], label: str, k: int, candidates: Sequence[dict]) -> DataFrame:
        """The rows once per candidate, with pred and prob by the fit without their fold: one fit for each
        fold and each setting of the other parameters, at the largest number of trees."""
        settings: dict[str, list[int]] = {}
        made = [self.with_params(**c) for c in candidates]
        for i, c in enumerate(made):
            settings.setdefault(repr(sorted((n, v) for n, v in c.params.items() if n != COUNT)), []).append(i)
        size = [c.factory(1, 1, **c.params) for c in made]
        size = [(e.getMaxIter if e.hasParam("maxIter") else e.getNumTrees)() for e in size]
        out = None
        for at in settings.values():
            most = max(at, key=lambda i: size[i])
            for f in range(k):
                fitted = made[most].fit(folded.where(F.col("fold") != f), features, label)
                held = staged_scores(fitted.model, folded.where(F.col("fold") == f), folded.columns, features, [size[i] for i in at])
                part = held.withColumn("candidate", F.array(*[F.lit(i) for i in at])[F.col("_at")]).drop("_at")
                out = part if out is None else out.unionByName(part)
        return cut_lineage(out.select(*[q(c) for c in folded.columns], "candidate", "pred", "prob"))

    def with_params(self, **params) -> "StagedClassifier":
        return StagedClassifier(self.name, self.factory, {**self.params, **params}, self.needs_n)
