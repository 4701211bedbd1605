"""Feature importances: random-forest impurity, |L1 logistic coefficients|, permutation
(accuracy drop) and mutual information, plus the ranked top-10 table.

Permutation: for repeat ``r`` the value of feature ``f`` in the row of rank ``i`` (by id) is
taken from the row of rank ``i`` in md5('<seed>:<r>:' || id) order - a distributed shuffle
by join. All (feature, repeat) copies are scored in one frame and reduced with one groupBy.
Mutual information: plug-in estimate on 10 equal-width or equal-frequency bins, one grouped count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tricolor.operators.models.base import VEC, FittedClassifier, assemble, pred_col
from tricolor.operators.profile import _bin, _min_max, q
from tricolor.sources.rowid import ordered_rank, rank_within

SEED = 42
# The deepest trees that Spark grows: importances come from forests that are not pruned.
MAX_DEPTH = 30


def _table(spark: SparkSession, feats: Sequence[str], values: Sequence[float], method: str) -> DataFrame:
    rows = [(method, f, float(v)) for f, v in zip(feats, values)]
    return spark.createDataFrame(rows, "method string, feature string, importance double")


def rf_importance(df: DataFrame, features: Sequence[str], label: str, n_trees: int = 100) -> DataFrame:
    rf = RandomForestClassifier(numTrees=n_trees, maxDepth=MAX_DEPTH, featureSubsetStrategy="sqrt", seed=SEED, maxBins=64,
                                featuresCol=VEC, labelCol=label)
    m = rf.fit(assemble(df.select(*features, q(label).cast("double").alias(label)), features))
    return _table(df.sparkSession, features, m.featureImportances.toArray(), "random_forest")


def lasso_importance(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0) -> DataFrame:
    n = df.count()
    lr = LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=1.0, standardization=False, maxIter=1000,
                            featuresCol=VEC, labelCol=label)
    m = lr.fit(assemble(df.select(*features, q(label).cast("double").alias(label)), features))
    return _table(df.sparkSession, features, [abs(c) for c in m.coefficients.toArray()], "lasso")


def permutation_importance(fitted: FittedClassifier, df: DataFrame, features: Sequence[str], label: str,
                           repeats: int = 10, seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """Mean accuracy drop (and its population std) over ``repeats`` shuffles per feature."""
    feats = list(features)
    base = df.select(q(id_col), *[q(f) for f in feats], q(label))
    base_pred = fitted.predict(base)
    base_acc = base_pred.agg(F.avg((F.col(pred_col(fitted.name)) == q(label)).cast("double")).alias("a")).first()["a"]
    # only ids are ranked: the n-th row takes the values of the n-th row of each shuffle
    ids = base.select(q(id_col))
    by_id = ordered_rank(ids, [q(id_col)], "_rank")
    reps = ids.select(q(id_col).alias("_donor"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_r").cast("string"), F.lit(":"), F.col("_donor").cast("string")))
    by_hash = rank_within(reps, "_r", [key, F.col("_donor")], "_rank")
    donors = base.select(q(id_col).alias("_donor"), *[q(f).alias(f"_d{j}") for j, f in enumerate(feats)])
    joined = by_hash.join(by_id, "_rank").join(base, id_col).join(donors, "_donor")
    copy = lambda f: F.struct(F.lit(f).alias("_feature"), *[
        (F.col(f"_d{j}") if g == f else q(g)).alias(g) for j, g in enumerate(feats)])
    copies = (joined.select("_r", q(id_col), q(label), F.explode(F.array(*[copy(f) for f in feats])).alias("_c"))
              .select("_r", q(id_col), q(label), "_c.*"))
    scored = fitted.predict(copies)
    acc = scored.groupBy("_feature", "_r").agg(
        F.avg((F.col(pred_col(fitted.name)) == q(label)).cast("double")).alias("acc"))
    return acc.groupBy(F.col("_feature").alias("feature")).agg(
        (F.lit(base_acc) - F.avg("acc")).alias("importance"), F.stddev_pop("acc").alias("std")
    ).select(F.lit("permutation").alias("method"), "feature", "importance", "std")


def _quantile_binned(df: DataFrame, features: Sequence[str], label: str, bins: int, id_col: str) -> DataFrame:
    """(feature, b, y) with equal-frequency bins: b = floor((rank - 1) * bins / n) in (x, id)
    order, the rank from the range-partitioned ``ordered_rank`` (no global window)."""
    from tricolor.sources.rowid import ordered_rank_n
    parts = None
    for f in features:
        d = df.where(q(label).isNotNull() & q(f).isNotNull()).select(q(id_col), q(f).cast("double").alias("_x"),
                                                                   q(label).alias("y"))
        ranked, n = ordered_rank_n(d, [F.col("_x"), q(id_col)], "_r")
        part = ranked.select(F.lit(f).alias("feature"),
                             F.floor((F.col("_r") - 1) * F.lit(bins) / F.lit(max(n, 1))).cast("int").alias("b"), "y")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10,
                       binning: str = "width", id_col: str = "row_id") -> DataFrame:
    """Plug-in MI (nats) between each binned feature and the label.

    ``binning="width"``: equal-width bins between min and max; ``"quantile"``: equal-frequency
    bins from the exact rank of (value, id).
    """
    feats = list(features)
    if binning == "quantile":
        c = _quantile_binned(df, feats, label, bins, id_col).groupBy("feature", "b", "y").agg(
            F.count(F.lit(1)).alias("n"))
        return _mi_from_counts(c)
    if binning != "width":
        raise ValueError("binning must be 'width' or 'quantile'")
    mm = _min_max(df, feats)
    long = df.where(q(label).isNotNull()).select(q(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), _bin(q(f).cast("double"), *mm[f], bins).alias("b")) for f in feats
        if mm[f][0] is not None])).alias("e")).where(F.col("e.b").isNotNull())
    c = long.groupBy("e.feature", "e.b", "y").agg(F.count(F.lit(1)).alias("n"))
    return _mi_from_counts(c)


def _mi_from_counts(c: DataFrame) -> DataFrame:
    """MI per feature from the (feature, b, y, n) count table (small: features x bins x classes)."""
    wf = Window.partitionBy("feature")
    c = c.select("feature", "b", "y", "n",
                 F.sum("n").over(wf).alias("nt"),
                 F.sum("n").over(Window.partitionBy("feature", "b")).alias("nb"),
                 F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"))
    term = (F.col("n") / F.col("nt")) * F.log((F.col("n") * F.col("nt")) / (F.col("nb") * F.col("ny")))
    return c.groupBy("feature").agg(F.sum(term).alias("importance")).select(
        F.lit("mutual_info").alias("method"), "feature", "importance")


def ranked(imp: DataFrame, top: int | None = None) -> DataFrame:
    """Importances with rank 1 = largest within each method; ``top`` keeps the best ``top``."""
    r = rank_within(imp, "method", [F.desc("importance"), F.col("feature")], "rank")
    return r.where(F.col("rank") <= top) if top else r


def global_rank(imp: DataFrame) -> DataFrame:
    return ordered_rank(imp, [F.desc("importance"), F.col("feature")], "rank")
