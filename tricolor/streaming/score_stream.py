"""Scoring a stream with a fitted recipe and fitted models.

The recipe (fills, label map, one-hot with fitted categories, alignment, finite filter,
scaling, derived features, drops) and the expression / ``pyspark.ml`` models are stateless
row maps, so they apply unchanged to a ``readStream`` DataFrame; no watermark or state is
involved. kNN (a blocked join against the training rows) is batch-only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tricolor.operators.evaluate import predict_all, score_table
from tricolor.operators.models.base import FittedClassifier
from tricolor.operators.models.knn import KNNFitted
from tricolor.plans.recipe import Recipe
from tricolor.session import scratch_path


def score_stream(stream: DataFrame, recipe: Recipe, models: Sequence[FittedClassifier],
                 flips: dict | None = None) -> DataFrame:
    """Streaming DataFrame of prepared rows with prediction, probability and light per model."""
    if any(_needs_batch(m) for m in models):
        raise ValueError("kNN scoring needs a batch join against the training rows; score it in batch")
    prepared = recipe.apply(stream, with_label=False)
    return score_table(predict_all(prepared, models), [m.name for m in models], flips)


def _needs_batch(m: FittedClassifier) -> bool:
    """kNN itself, or a vote or stack that holds one."""
    inner = [x for x in vars(m).values() for x in (x if isinstance(x, (list, tuple)) else [x]) if isinstance(x, FittedClassifier)]
    return isinstance(m, KNNFitted) or any(_needs_batch(x) for x in inner)


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available(scored: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available now into a parquet sink (exactly-once via the checkpoint)."""
    q = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def score_files(spark: SparkSession, source: DataFrame, recipe: Recipe, models: Sequence[FittedClassifier],
                flips: dict | None = None) -> DataFrame:
    """Write ``source`` as files, score them as a stream into the shared folder, read the result."""
    src = scratch_path(spark, "stream-in")
    source.write.mode("overwrite").parquet(src)
    stream = read_parquet_stream(spark, src, source.schema)
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    run_available(score_stream(stream, recipe, models, flips), out, ckpt)
    return spark.read.parquet(out)
