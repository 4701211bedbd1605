"""Two-valued targets: check, map to 0/1, alternative codings, decode, test-set checks and
the class distribution.

Only the values of a binary check reach the driver; code tables are ranked by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.operators.profile import q
from tricolor.sources.rowid import ordered_rank


class LabelError(ValueError):
    pass


def binary_values(df: DataFrame, target: str) -> list:
    """The two distinct non-null target values (sorted), or an error."""
    vals = [r[0] for r in df.select(q(target)).where(q(target).isNotNull()).distinct().limit(3).collect()]
    if len(vals) != 2:
        raise LabelError(f"target {target!r} must have exactly two distinct values, found {len(vals)}")
    return sorted(vals, key=lambda v: (str(type(v)), v))


def map_label(df: DataFrame, target: str, zero_value, one_value, out: str | None = None,
              check: bool = True) -> DataFrame:
    """``zero_value`` -> 0, ``one_value`` -> 1 (bigint). Unmapped or NULL rows are an error."""
    out = out or target
    t = q(target)
    code = F.when(t == F.lit(zero_value), F.lit(0)).when(t == F.lit(one_value), F.lit(1)).cast("bigint")
    if out == target:
        mapped = df.select(*[code.alias(out) if c == target else q(c) for c in df.columns])
    else:
        mapped = df.select(*[q(c) for c in df.columns if c != out], code.alias(out))
    if check:
        bad = mapped.agg(F.count_if(F.col(f"`{out}`").isNull()).alias("n")).first()["n"]
        if bad:
            raise LabelError(f"{bad} rows of {target!r} are NULL or outside {{{zero_value!r}, {one_value!r}}}")
    return mapped


def encode_test_label(df: DataFrame, target: str, zero_value, one_value) -> DataFrame:
    """Test-side mapping: same codes, rows whose target does not map are dropped."""
    mapped = map_label(df, target, zero_value, one_value, check=False)
    return mapped.where(q(target).isNotNull())


def factorize_codes(df: DataFrame, target: str, order_col: str = "row_id") -> DataFrame:
    """(value, code): codes 0,1,.. by first appearance in ``order_col`` order."""
    firsts = df.where(q(target).isNotNull()).groupBy(q(target).alias("value")).agg(
        F.min(q(order_col)).alias("_first"))
    return ordered_rank(firsts, [F.col("_first"), F.col("value")], "_r").select("value", (F.col("_r") - 1).cast("bigint").alias("code"))


def sorted_codes(df: DataFrame, target: str) -> DataFrame:
    """(value, code): codes 0,1,.. by ascending value."""
    vals = df.where(q(target).isNotNull()).select(q(target).alias("value")).distinct()
    return ordered_rank(vals, [F.col("value")], "_r").select("value", (F.col("_r") - 1).cast("bigint").alias("code"))


def decode_label(col_name: str, mapping: dict) -> "F.Column":
    """Integer code -> original label (as string); unknown codes pass through."""
    if not mapping:
        return q(col_name).cast("string")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(str(v))]
    return F.coalesce(F.create_map(*kv)[q(col_name)], q(col_name).cast("string"))


def check_test_labels(train: DataFrame, test: DataFrame, target: str) -> None:
    """The test label set must equal the training label set; the error names both."""
    a = train.select(q(target).alias("v")).where(F.col("v").isNotNull()).distinct()
    b = test.select(q(target).alias("v")).where(F.col("v").isNotNull()).distinct()
    diff = a.exceptAll(b).unionByName(b.exceptAll(a))
    if not diff.isEmpty():
        sets = [sorted(str(r[0]) for r in x.collect()) for x in (a, b)]
        raise LabelError(f"test labels {sets[1]} differ from training labels {sets[0]}")


def check_coded_labels(test: DataFrame, target: str, values: Sequence) -> int:
    """Test targets must be among the coded training values (the error names both sets); returns
    the number of rows without a target, which scoring leaves out."""
    t = q(target)
    unknown = test.where(t.isNotNull() & ~t.isin(list(values)))
    if not unknown.isEmpty():
        found = sorted(str(r[0]) for r in test.select(t).where(t.isNotNull()).distinct().collect())
        raise LabelError(f"test labels {found} differ from training labels {sorted(map(str, values))}")
    return test.where(t.isNull()).count()


def label_set_diff(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """(value, side) for values present on one side only; empty when the sets are equal."""
    a = train.select(q(target).alias("value")).where(F.col("value").isNotNull()).distinct()
    b = test.select(q(target).alias("value")).where(F.col("value").isNotNull()).distinct()
    return (a.exceptAll(b).withColumn("side", F.lit("train_only"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("test_only"))))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, count, percentage): share of non-null rows, rounded to 2, sorted by class."""
    counts = df.where(q(target).isNotNull()).groupBy(q(target).alias("class")).agg(
        F.count(F.lit(1)).alias("count"))
    return counts.select("class", "count", F.round(
        F.col("count") * F.lit(100.0) / F.sum("count").over(Window.partitionBy()), 2).alias("percentage")
    ).orderBy("class")


def label_counts(df: DataFrame, target: str, stage: str) -> DataFrame:
    return (df.groupBy(q(target).alias("class")).agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit(stage).alias("stage"), "class", "count"))
