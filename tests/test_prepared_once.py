"""Fits read their prepared rows from where they are kept: the preparation is not replayed for each pass."""

import pytest
from pyspark.sql import functions as F

from tricolor.operators.models.catalog import model

N = 200


@pytest.fixture
def counted(spark):
    """Rows whose preparation counts how many rows it has seen."""
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    df = spark.range(N).select(F.col("id").alias("row_id"), F.rand(1).alias("u"), (F.col("id") % 2).alias("y"))
    df = df.select("row_id", "y", F.udf(look, "double")("u").alias("a")).where(F.col("a") >= 0)
    return df.select("row_id", (F.col("a") + 0.2 * F.col("y")).alias("a"), "y"), seen


def test_spark_ml_fit(counted):
    df, seen = counted
    model("Ridge", max_iter=2).fit(df, ["a"], "y")
    assert seen.value <= 2 * N


def test_svm_fit(counted):
    df, seen = counted
    model("SVM", n_components=3, max_iter=2).fit(df, ["a"], "y")
    assert seen.value <= 5 * N
