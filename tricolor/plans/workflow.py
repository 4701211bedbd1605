"""End-to-end plans: prepare training data, fit and evaluate models, score a new table.

``prepared_task`` is the shared preparation of the documents task: split, recipe fitted on
the training part (one-hot ``lang``, standardised numeric features), replayed on validation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tricolor.operators.evaluate import predict_all, validation_table
from tricolor.operators.models.catalog import model
from tricolor.operators.sampling import split_train_val
from tricolor.plans.recipe import Recipe
from tricolor.sources import fixtures as fx

LABEL = "quality"


@dataclass
class Prepared:
    recipe: Recipe
    train: DataFrame
    val: DataFrame
    features: list[str]


def prepared_task(spark: SparkSession, sf_dir: str, standardise: bool = True) -> Prepared:
    task = fx.docs_task(spark, sf_dir).drop("doc_id", "source")
    s = split_train_val(task, 0.2)
    train, val = s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")
    r = Recipe(LABEL)
    t = r.fit_base(train, 0, 1, categorical=["lang"])
    if standardise:
        t = r.standard(t, fx.FEATURES)
    return Prepared(r, t, r.apply(val), list(r.features))


def scoring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (labelled or not) with its target where known: the table to score."""
    return fx.docs_nulls(spark, sf_dir).drop("doc_id", "source", "toxic")


def flagship_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents+labels -> features -> split -> recipe -> ridge -> validation metrics."""
    p = prepared_task(spark, sf_dir)
    ridge = model("Ridge").fit(p.train, p.features, LABEL)
    return validation_table(predict_all(p.val, [ridge]), ["Ridge"], LABEL)
