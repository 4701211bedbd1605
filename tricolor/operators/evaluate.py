"""Evaluation and scoring tables over one prediction frame.

* ``long_predictions``: (model, row_id, y, pred, prob) from the wide per-model columns, one
  explode - so the metrics of every model come from one grouped pass;
* ``validation_table`` / ``test_table``: accuracy, precision, recall, F1, AUC per model, the
  test table flagging AUC < 0.5 (label inversion);
* ``score_table``: flip, traffic light and the three output columns per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.functions.scalar import DEFAULT_T0, DEFAULT_T1, fn_flip_pred, fn_flip_prob, fn_flip_score, fn_traffic
from tricolor.operators.labels import decode_label
from tricolor.operators.metrics import binary_metrics
from tricolor.operators.models.base import FittedClassifier, pred_col, prob_col
from tricolor.operators.profile import q
from tricolor.session import cut_lineage


def predict_all(df: DataFrame, models: Sequence[FittedClassifier]) -> DataFrame:
    """Chain every model's prediction onto one frame (one wide row per id). An error is an error;
    ``predict_usable`` also says which models cannot score the frame."""
    out = df
    for m in models:
        out = m.predict(out)
    return out


def predict_usable(df: DataFrame, models: Sequence[FittedClassifier]) -> tuple[DataFrame, DataFrame]:
    """(predictions of the models that accept the frame, (model, error) of those that do not).

    Spark checks a plan's columns and types when it is built, so this finds models whose features
    the frame lacks; failures while running are not caught.
    """
    out, skipped = df, []
    for m in models:
        try:
            out = m.predict(out)
        except (AnalysisException, IllegalArgumentException) as e:
            skipped.append((m.name, str(e)))
    return out, df.sparkSession.createDataFrame(skipped, "model string, error string")


def long_predictions(wide: DataFrame, names: Sequence[str], label: str | None, id_col: str = "row_id") -> DataFrame:
    present = [n for n in names if pred_col(n) in wide.columns]
    entries = [F.struct(F.lit(n).alias("model"), F.col(pred_col(n)).cast("int").alias("pred"),
                        F.col(prob_col(n)).cast("double").alias("prob")) for n in present]
    cols = [q(id_col)] + ([q(label).alias("y")] if label else [])
    return wide.select(*cols, F.explode(F.array(*entries)).alias("e")).select(*[c for c in [id_col] + (["y"] if label else [])],
                                                                          "e.model", "e.pred", "e.prob")


def validation_table(wide: DataFrame, names: Sequence[str], label: str, id_col: str = "row_id") -> DataFrame:
    # the metrics read the predictions three times (counts, per-score groups, totals); the narrow
    # long form is materialised once so no model scores a row twice
    longp = cut_lineage(long_predictions(wide, names, label, id_col))
    m = binary_metrics(longp, "y", "pred", "prob", ["model"])
    return m.select("model", "accuracy", "precision", "recall", "f1", "auc")


def test_table(wide: DataFrame, names: Sequence[str], label: str, id_col: str = "row_id") -> DataFrame:
    v = validation_table(wide, names, label, id_col)
    return v.select("*", (F.col("auc") < 0.5).alias("auc_below_half"))


def train_export(fitted: FittedClassifier, df: DataFrame, features: Sequence[str], label: str,
                 id_col: str = "row_id", flip: bool = False, label_names: dict | None = None) -> DataFrame:
    """row_id first, features, target, ``{model}_Prediction``, ``{model}_Prob``, and on request the
    original label names. A flip turns the target, the prediction and the output (``1 - p``, also
    for a continuous score) around, so that the metrics compare like with like."""
    p = fitted.predict(df)
    n = fitted.name
    target, pred, prob = q(label), F.col(pred_col(n)), F.col(prob_col(n))
    if flip:
        target, pred, prob = (1 - target).cast(df.schema[label].dataType), fn_flip_pred(pred), fn_flip_prob(prob)
    cols = [q(id_col), *[q(f) for f in features], target.alias(label), pred.alias(pred_col(n)), prob.alias(prob_col(n))]
    out = p.select(*cols)
    if label_names:
        out = out.select("*", decode_label(label, label_names).alias(f"{label}_name"),
                         decode_label(pred_col(n), label_names).alias(f"{n}_Prediction_name"))
    return out


def train_export_metrics(export: DataFrame, name: str, label: str) -> DataFrame:
    """accuracy, precision, recall, f1 and auc of an export (flipped or not)."""
    m = binary_metrics(export, label, pred_col(name), prob_col(name))
    return m.select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "auc")


def score_table(wide: DataFrame, names: Sequence[str], flips: dict | None = None, t0: float = DEFAULT_T0,
                t1: float = DEFAULT_T1, continuous: Sequence[str] = ("PLSDA",)) -> DataFrame:
    """Per model: optional flip, then ``_TrafficLight`` next to ``_Prediction`` and ``_Prob``."""
    flips = flips or {}
    out = []
    handled = set()
    for n in names:
        if pred_col(n) not in wide.columns:
            continue
        pred, prob = F.col(pred_col(n)), F.col(prob_col(n))
        if flips.get(n):
            pred = fn_flip_pred(pred)
            prob = fn_flip_score(prob) if n in continuous else fn_flip_prob(prob)
        out += [pred.alias(pred_col(n)), prob.alias(prob_col(n)), fn_traffic(pred, prob, t0, t1).alias(f"{n}_TrafficLight")]
        handled |= {pred_col(n), prob_col(n)}
    base = [q(c) for c in wide.columns if c not in handled]
    return wide.select(*base, *out)
