"""User-level flow for any table: prepare -> train and evaluate -> score and export.

``train(...)`` numbers the rows, fits the recipe on the training part (fills, label map,
one-hot, scaling), optionally removes training outliers, rebalances and reduces dimensions,
fits the chosen classifiers and returns them with the validation table.
``score(...)`` replays the recipe (and PCA) on a new table, predicts with every model,
applies flips and the traffic light, assembles the export table and, when the target is
present, the test metrics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.functions.scalar import DEFAULT_T0, DEFAULT_T1
from tricolor.operators import sampling as smp
from tricolor.operators.columns import require_columns
from tricolor.operators.evaluate import predict_all, predict_usable, score_table, test_table, validation_table
from tricolor.operators.labels import check_coded_labels
from tricolor.operators.missing import MissingStep
from tricolor.operators.models.base import Classifier, FittedClassifier
from tricolor.operators.models.catalog import model
from tricolor.operators.pca import PcaModel
from tricolor.plans.recipe import Recipe
from tricolor.sources.rowid import add_row_id

ID = "row_id"


@dataclass
class TrainedRun:
    label: str
    recipe: Recipe
    features: list[str]
    models: list[FittedClassifier]
    train: DataFrame
    val: DataFrame
    pca: PcaModel | None = None
    pca_k: int = 0
    validation: DataFrame | None = None
    outliers: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    persisted: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Unpersist the cached training part (call when the run is no longer needed)."""
        for d in self.persisted:
            d.unpersist()
        self.persisted.clear()


def _final(df: DataFrame, run_pca: PcaModel | None, k: int, label: str | None) -> DataFrame:
    if run_pca is None:
        return df
    keep = [ID] + ([label] if label and label in df.columns else [])
    return run_pca.transform(df, k, keep)


def train(df: DataFrame, label: str, zero_value, one_value, models: Sequence[str | Classifier] = ("Ridge",),
          key_cols: Sequence[str] | None = None, val_fraction: float = 0.2,
          missing: Sequence[MissingStep] = (), categorical: Sequence[str] | None = None,
          scaling: str | None = "standard", outlier_columns: Sequence[str] = (),
          resample: str | None = None, pca_k: int | None = None, drop: Sequence[str] = (),
          derived: Sequence[tuple] = (), seed: int = 42) -> TrainedRun:
    """Fit the recipe and the models on the training part; validation table for every model.

    ``key_cols`` number the rows and are never features. ``derived`` are (operation, column,
    second column or None[, name]) steps after scaling. ``outliers`` of the result has the ids and
    columns of the training rows that the IQR filters removed.
    """
    if not 0.1 <= val_fraction <= 0.5:
        raise ValueError("validation share must lie between 10 % and 50 %")
    # ids are ranked on narrow keys and joined back and the split is a filter, so a wide input is
    # not checkpointed whole; the training part is persisted once for the recipe's fit passes
    numbered = add_row_id(df, key_cols, narrow=key_cols is not None)
    s = smp.split_train_val(numbered, val_fraction, seed)
    tr = s.where(~F.col("is_val")).drop("is_val").persist()
    va = s.where(F.col("is_val")).drop("is_val")
    r = Recipe(label, keys=tuple(key_cols or ()))
    t = r.fit_base(tr, zero_value, one_value, missing, categorical)
    numeric = list(r.features)
    if scaling == "standard":
        t = r.standard(t, numeric)
    elif scaling == "minmax":
        t = r.minmax(t, numeric)
    elif scaling is not None:
        raise ValueError("scaling must be 'standard', 'minmax' or None")
    for step in derived:
        t = r.feature(t, *step)
    removed = None
    for c in outlier_columns:
        before = t
        t = r.outliers(t, c)
        gone = r.steps[-1][1].removed(before).select(ID, F.lit(c).alias("column"))
        removed = gone if removed is None else removed.unionByName(gone)
    if drop:
        t = r.drop(t, drop)
    # ids of synthetic rows start after the largest id of any row, the validation part included
    top = numbered.agg(F.max(ID)).first()[0] or 0 if resample in ("over", "smote") else None
    if resample == "under":
        t = smp.under_sample(t, label, seed)
    elif resample == "over":
        t = smp.over_sample(t, label, seed, max_id=top)
    elif resample == "smote":
        t = smp.smote(t, label, r.features, seed=seed, max_id=top)
    elif resample is not None:
        raise ValueError("resample must be 'under', 'over', 'smote' or None")
    if resample:
        r.steps.append(("resample", (resample, seed)))
    v = r.apply(va)
    feats = list(r.features)
    pca = None
    if pca_k:
        pca = PcaModel.fit(t, feats)
        t, v = _final(t, pca, pca_k, label), _final(v, pca, pca_k, label)
        feats = [f"PC{i + 1}" for i in range(pca_k)]
    clfs = [model(m) if isinstance(m, str) else m for m in models]
    fitted = [c.fit(t, feats, label) for c in clfs]
    val_table = validation_table(predict_all(v, fitted), [m.name for m in fitted], label)
    return TrainedRun(label, r, feats, fitted, t, v, pca, pca_k or 0, val_table, removed, persisted=[tr])


@dataclass
class Scored:
    results: DataFrame
    metrics: DataFrame | None
    removed_rows: int = 0        # rows left out because a feature is not finite
    without_target: int = 0      # rows left out because their target is NULL
    skipped: DataFrame | None = None   # (model, error) of the models that cannot score the table


def score(run: TrainedRun, test: DataFrame, key_cols: Sequence[str] | None = None, flips: dict | None = None,
          t0: float = DEFAULT_T0, t1: float = DEFAULT_T1, include_original: bool = True) -> Scored:
    """Replay, predict, flip, traffic light and export; metrics when the target is present.

    Refuses a table that lacks a column the features come from, or whose target has a value that
    training did not know. Rows without a target (where the table has one) and rows with a feature
    that is not finite are left out and counted. A model whose features the prepared table lacks is left out
    of the results and named in ``skipped``; an error only if none is left.
    """
    has_target = run.label in test.columns
    require_columns(test, run.recipe.required)
    without = check_coded_labels(test, run.label, run.recipe.label_values) if has_target else 0
    numbered = add_row_id(test, key_cols)
    removed = run.recipe.removed_rows(numbered, with_label=has_target)
    prepared = run.recipe.apply(numbered, with_label=has_target)
    final = _final(prepared, run.pca, run.pca_k, run.label if has_target else None)
    wide, skipped = predict_usable(final, run.models)
    names = [m.name for m in run.models if f"{m.name}_Prediction" in wide.columns]
    if not names:
        raise ValueError(f"no model can score the table: {[r['model'] for r in skipped.collect()]}")
    metrics = test_table(wide, names, run.label) if has_target else None
    scored = score_table(wide, names, flips, t0, t1)
    feats = [c for c in run.features if c in scored.columns and not c.startswith("PC")]
    pcs = [c for c in scored.columns if c.startswith("PC")]
    preds = [f"{n}{sfx}" for n in names for sfx in ("_Prediction", "_Prob", "_TrafficLight")
             if f"{n}{sfx}" in scored.columns]
    transformed = scored.select(ID, *[F.col(f"`{c}`").alias(f"TF_{c}") for c in feats],
                                *[F.col(c) for c in pcs + preds])
    originals = [c for c in test.columns if c != ID] if include_original else []
    # keyed join back to the untouched input (rows the recipe drops are not exported)
    joined = numbered.select(ID, *[F.col(f"`{c}`") for c in originals]).join(transformed, ID)
    return Scored(joined, metrics, removed, without, skipped)
