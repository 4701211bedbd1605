"""The preparation recipe: fitted steps recorded on training data and replayed anywhere.

Order of replay on a new table (batch or streaming; every step is a projection or filter):
missing-value fills -> label map -> one-hot with the fitted categories -> alignment to the
fitted feature list -> finite filter -> scaling / derived features in recorded order ->
column drops. Train-only steps (outlier removal, rebalancing) are recorded but not replayed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tricolor.operators import columns as cols
from tricolor.operators.encode import NullValuesError, OneHotEncoding
from tricolor.operators.labels import LabelError, encode_test_label, map_label
from tricolor.operators.missing import MissingStep, apply_missing, fit_missing
from tricolor.operators.transform import MinMaxScaling, NewFeature, StandardScaling


@dataclass
class Recipe:
    label: str
    id_col: str = "row_id"
    keys: tuple[str, ...] = ()               # declared keys: never features
    required: list[str] = field(default_factory=list)   # source columns the features come from
    missing: list[MissingStep] = field(default_factory=list)
    label_values: tuple | None = None        # (value coded 0, value coded 1)
    encoding: OneHotEncoding | None = None
    base_features: list[str] = field(default_factory=list)   # after encoding, before derived features and drops
    features: list[str] = field(default_factory=list)
    steps: list[tuple[str, object]] = field(default_factory=list)

    # -- fitting -----------------------------------------------------------------------
    def fit_base(self, df: DataFrame, zero_value, one_value, missing: Sequence[MissingStep] = (),
                 categorical: Sequence[str] | None = None) -> DataFrame:
        """Fit fills, label map and one-hot on ``df``; return the encoded, finite training frame."""
        df = df.drop(*self.keys)
        self.required = [c for c in df.columns if c not in (self.id_col, self.label)]
        self.missing = fit_missing(df, list(missing))
        filled = apply_missing(df, self.missing)
        self.label_values = (zero_value, one_value)
        # the unmapped-target check runs inside the category job (one pass, not two)
        labelled = map_label(filled, self.label, zero_value, one_value, check=False)
        try:
            self.encoding = OneHotEncoding.fit(labelled, categorical, require_not_null=self.label)
        except NullValuesError as e:
            raise LabelError(f"target {self.label!r}: rows are NULL or outside "
                             f"{{{zero_value!r}, {one_value!r}}}") from e
        encoded = self.encoding.transform(labelled)
        self.base_features = [c for c in encoded.columns if c not in (self.id_col, self.label)]
        self.features = list(self.base_features)
        return cols.drop_non_finite(self._aligned(encoded), self.base_features)

    def _aligned(self, encoded: DataFrame) -> DataFrame:
        keep = [c for c in (self.id_col, self.label) if c in encoded.columns]
        return cols.align_to(encoded, self.base_features, keep=keep)

    def base(self, df: DataFrame, with_label: bool = True) -> DataFrame:
        """Replay fills, label map (rows without a target dropped), encoding and alignment.

        A table without a source column of the features is refused: filling it with a constant
        would give predictions that mean nothing. Unknown categories and absent indicator columns
        are 0, as in training.
        """
        return cols.drop_non_finite(self._encoded(df, with_label), self.base_features)

    def removed_rows(self, df: DataFrame, with_label: bool = True) -> int:
        """Rows that ``base`` leaves out because a feature is not finite, counted in one pass."""
        return cols.count_non_finite(self._encoded(df, with_label), self.base_features)

    def _encoded(self, df: DataFrame, with_label: bool) -> DataFrame:
        cols.require_columns(df, self.required)
        filled = apply_missing(df.drop(*self.keys), self.missing)
        if with_label and self.label in filled.columns:
            filled = encode_test_label(filled, self.label, *self.label_values)
        return self._aligned(self.encoding.transform(filled) if self.encoding else filled)

    def minmax(self, train: DataFrame, columns: Sequence[str]) -> DataFrame:
        s = MinMaxScaling.fit(train, columns)
        self.steps.append(("minmax", s))
        return s.transform(train)

    def standard(self, train: DataFrame, columns: Sequence[str]) -> DataFrame:
        s = StandardScaling.fit(train, columns)
        self.steps.append(("standard", s))
        return s.transform(train)

    def feature(self, train: DataFrame, op: str, a: str, b: str | None = None, name: str | None = None) -> DataFrame:
        f = NewFeature(op, a, b, name)
        self.steps.append(("feature", f))
        if f.out not in self.features:
            self.features.append(f.out)
        return f.transform(train)

    def outliers(self, train: DataFrame, column: str, k: float = 1.5) -> DataFrame:
        """Train-only IQR filter: recorded for the log, never replayed."""
        f = cols.IqrFilter.fit(train, column, k)
        self.steps.append(("outlier", f))
        return f.keep(train)

    def drop(self, train: DataFrame, columns: Sequence[str]) -> DataFrame:
        self.steps.append(("drop", tuple(columns)))
        self.features = [c for c in self.features if c not in columns]
        return cols.drop_columns(train, columns)

    # -- replay ------------------------------------------------------------------------
    def replay(self, df: DataFrame) -> DataFrame:
        """Scaling and features in recorded order (absent columns skipped), then drops."""
        out = df
        drops: list[str] = []
        for kind, step in self.steps:
            if kind in ("minmax", "standard", "feature"):
                out = step.transform(out)
            elif kind == "drop":
                drops += list(step)
        return cols.drop_columns(out, drops)

    def apply(self, df: DataFrame, with_label: bool = True) -> DataFrame:
        return self.replay(self.base(df, with_label))

    def describe(self, spark: SparkSession) -> DataFrame:
        rows = [(0, "missing", f"{s.method}({s.column})={s.value}") for s in self.missing]
        if self.label_values:
            rows.append((0, "label", f"{self.label}: {self.label_values[0]!r}->0, {self.label_values[1]!r}->1"))
        if self.encoding:
            for c in self.encoding.columns:
                rows.append((0, "onehot", f"{c}: {list(self.encoding.categories.get(c, ()))} (first dropped)"))
        for i, (kind, step) in enumerate(self.steps):
            if kind == "minmax":
                detail = "; ".join(f"{c}: min={mn}, max={mx}" for c, mn, mx in step.stats)
            elif kind == "standard":
                detail = "; ".join(f"{c}: mean={m}, std={s}" for c, m, s in step.stats)
            elif kind == "feature":
                detail = f"{step.out} = {step.op}({step.col1}, {step.col2})"
            elif kind == "outlier":
                detail = f"{step.column}: keep [{step.lower}, {step.upper}] (train only)"
            elif kind == "resample":
                detail = f"{step[0]} (seed {step[1]}, train only)"
            else:
                detail = f"drop {list(step)}"
            rows.append((i + 1, kind, detail))
        return spark.createDataFrame(rows, "step int, kind string, detail string")
