"""Binary classification metrics, optionally per group (e.g. per model or per fold).

* confusion metrics: one aggregate of ``count_if``; a zero denominator gives 0;
* AUC: exact, ties count one half. Scores are first reduced to (group, score, pos, neg),
  then the running count of negatives over all groups comes from the range-partitioned running
  sum, so no group (a model's whole validation set) is ever gathered into one task. A group's own
  count starts at its smallest running count:
  ``AUC = sum(pos * (neg_before - start + neg / 2)) / (P * N)``, summed exactly in decimals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.operators.profile import q
from tricolor.sources.rowid import ordered_running_sum


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_metrics(df: DataFrame, label: str, pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1 with positive class 1 (and the four counts)."""
    y, p = q(label), q(pred)
    aggs = [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
            F.count(F.lit(1)).alias("n")]
    g = df.groupBy(*[q(c) for c in group_cols]).agg(*aggs) if group_cols else df.agg(*aggs)
    prec = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.select(*[q(c) for c in group_cols], "tp", "fp", "fn", "tn", "n",
                    _ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _ratio(F.lit(2.0) * prec * rec, prec + rec).alias("f1"))


def auc(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC per group; NULL when a score is NULL or a class is missing."""
    gcols = list(group_cols)
    y, s = q(label), q(score)
    per_score = (df.where(s.isNotNull())
                 .groupBy(*[q(c) for c in gcols], s.cast("double").alias("_s"))
                 .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))
    order = [F.col(f"`{c}`").asc_nulls_first() for c in gcols] + [F.col("_s")]
    cum = ordered_running_sum(per_score, order, ["neg"], prefix="cum_")
    # twice the sum, in whole numbers: pos * (2 * cum_neg - neg) less 2 * start * pos
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    sums = [F.sum(wide(F.col("pos"), 18) * wide(F.col("cum_neg") * 2 - F.col("neg"), 19)).alias("_twice"),
            F.sum("pos").alias("_pos"), F.min(F.col("cum_neg") - F.col("neg")).alias("_start")]
    totals = [F.count_if(y == 1).alias("P"), F.count_if(y == 0).alias("N"), F.count_if(s.isNull()).alias("n_null")]
    keys = [q(c) for c in gcols]
    per_group = cum.groupBy(*keys).agg(*sums) if gcols else cum.agg(*sums)
    whole = df.groupBy(*keys).agg(*totals) if gcols else df.agg(*totals)
    joined = join_groups(whole, per_group, gcols)
    twice = F.col("_twice") - wide(F.col("_start"), 18) * wide(F.col("_pos") * 2, 19)
    ok = (F.col("P") > 0) & (F.col("N") > 0) & (F.col("n_null") == 0)
    area = twice.cast("double") / (F.lit(2.0) * F.col("P") * F.col("N"))
    return joined.select(*keys, "P", "N", F.when(ok, area).alias("auc"))


def join_groups(a: DataFrame, b: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Left join of two per-group aggregates; a NULL group is a group like any other."""
    if not group_cols:
        return _one_row_join(a, b)
    b = b.withColumnsRenamed({c: f"_g_{i}" for i, c in enumerate(group_cols)})
    cond = None
    for i, c in enumerate(group_cols):
        same = q(c).eqNullSafe(F.col(f"_g_{i}"))
        cond = same if cond is None else cond & same
    return a.join(b, cond, "left").drop(*[f"_g_{i}" for i in range(len(group_cols))])


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two single-row aggregates on a constant key."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def binary_metrics(df: DataFrame, label: str, pred: str, prob: str,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1, auc in one row per group."""
    cm = confusion_metrics(df, label, pred, group_cols)
    a = auc(df, label, prob, group_cols).select(*group_cols, "auc")
    return join_groups(cm, a, list(group_cols))
