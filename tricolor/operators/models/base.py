"""Common classifier interface.

``Classifier.fit(df, features, label) -> FittedClassifier``;
``FittedClassifier.predict(df)`` appends ``{name}_Prediction`` (int) and ``{name}_Prob``
(probability of the class coded 1, or a continuous score for PLS-DA) to ``df`` in one pass.
The ``row_id`` key rides along; features are never the id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VEC = "_tc_features"


def pred_col(name: str) -> str:
    return f"{name}_Prediction"


def prob_col(name: str) -> str:
    return f"{name}_Prob"


class FittedClassifier:
    name: str
    features: list[str]

    def predict(self, df: DataFrame) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    def params(self) -> dict:
        return {}


class Classifier:
    name: str

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> FittedClassifier:  # pragma: no cover
        raise NotImplementedError

    def with_params(self, **params) -> "Classifier":  # pragma: no cover
        raise NotImplementedError

    # Learners whose statistics add up over folds also have
    #   fold_scores(folded, features, label, k, candidates) -> rows x candidates with pred and prob
    # and are cross-validated without a fit per fold (``operators.models.additive``).


def assemble(df: DataFrame, features: Sequence[str], out: str = VEC) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


@dataclass
class SparkMLFitted(FittedClassifier):
    name: str
    features: list[str]
    model: object
    extra: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        keep = df.columns
        out = self.model.transform(assemble(df, self.features))
        return out.select(*[F.col(f"`{c}`") for c in keep],
                          F.col("prediction").cast("int").alias(pred_col(self.name)),
                          vector_to_array(F.col("probability"))[1].alias(prob_col(self.name)))

    def params(self) -> dict:
        return dict(self.extra)


@dataclass
class SparkMLClassifier(Classifier):
    """A ``pyspark.ml`` probabilistic classifier built by ``factory(n_rows, n_features, **params)``."""

    name: str
    factory: object
    params: dict = field(default_factory=dict)
    needs_n: bool = False

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> FittedClassifier:
        feats = list(features)
        data = assemble(df.select(*feats, F.col(label).cast("double").alias(label)), feats).persist()
        try:
            n = data.count()   # of the persisted rows: the preparation runs once
            est = self.factory(n, len(feats), **self.params)
            model = est.setFeaturesCol(VEC).setLabelCol(label).fit(data)
        finally:
            data.unpersist()
        return SparkMLFitted(self.name, feats, model, dict(self.params))

    def with_params(self, **params) -> "SparkMLClassifier":
        return SparkMLClassifier(self.name, self.factory, {**self.params, **params}, self.needs_n)
