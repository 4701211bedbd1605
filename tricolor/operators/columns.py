"""Projections and row filters: select, drop, split features/label, column kinds,
required-column checks, re-indexing and alignment to fitted columns, casts, renames,
target / category / not-null / finite filters and the IQR outlier filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricolor.operators.profile import iqr_fences, q


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[q(c) for c in columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist (absent names are ignored, as on validation data)."""
    return df.drop(*[c for c in columns if c in df.columns])


def split_xy(df: DataFrame, label: str, id_col: str = "row_id") -> tuple[list[str], DataFrame]:
    """Feature names (all but id and label) and the frame with id, features, label in one row."""
    feats = [c for c in df.columns if c not in (label, id_col)]
    cols = ([id_col] if id_col in df.columns else []) + feats + [label]
    return feats, df.select(*[q(c) for c in cols])


def column_kinds(df: DataFrame, exclude: Sequence[str] = ("row_id",)) -> DataFrame:
    """(column, kind) for every column except ``exclude``; kind in numeric/string/boolean/other."""
    rows = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            kind = "numeric"
        elif isinstance(f.dataType, T.StringType):
            kind = "string"
        elif isinstance(f.dataType, T.BooleanType):
            kind = "boolean"
        else:
            kind = "other"
        rows.append((f.name, kind))
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise listing every expected column absent from ``df``; else return ``df``."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"missing required columns: {missing}")
    return df


def reindex(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Project to ``columns`` in that order; absent ones are the constant ``fill``."""
    return df.select(*[q(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def align_to(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Force an encoded frame to the fitted feature list: add missing as 0.0, drop extras,
    reorder, cast to double. Columns in ``keep`` (ids, label) ride along in front."""
    front = [q(c) for c in keep if c in df.columns]
    return df.select(*front, *[(q(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c)
                               for c in features])


def cast_features(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Features -> double, label -> bigint; everything else unchanged."""
    fs = set(features)
    out = []
    for c in df.columns:
        if c in fs:
            out.append(q(c).cast("double").alias(c))
        elif c == label:
            out.append(q(c).cast("bigint").alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def prefix_columns(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    names = set(columns) if columns is not None else set(df.columns)
    return df.select(*[q(c).alias(f"{prefix}{c}") if c in names else q(c) for c in df.columns])


def filter_target(df: DataFrame, target: str, value=None) -> DataFrame:
    """``target = value``; ``None`` keeps every row."""
    return df if value is None else df.where(q(target) == F.lit(value))


def filter_category(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(q(column) == F.lit(value))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def finite_or_null(c: str) -> Column:
    x = q(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(None).cast("double")).otherwise(x)


def drop_non_finite(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """±inf and NaN -> NULL in the features, then drop rows NULL in any feature."""
    fs = set(features)
    cleaned = df.select(*[finite_or_null(c).alias(c) if c in fs else q(c) for c in df.columns])
    return cleaned.na.drop(how="any", subset=list(features))


def count_non_finite(df: DataFrame, features: Sequence[str]) -> int:
    """Rows the finite filter removes, counted in one pass."""
    bad = F.lit(False)
    for c in features:
        bad = bad | finite_or_null(c).isNull()
    return df.agg(F.count_if(bad).alias("n")).first()["n"]


@dataclass(frozen=True)
class IqrFilter:
    """Fitted IQR fences for one column; rows strictly outside are outliers, NULL is kept."""

    column: str
    q1: float | None
    q3: float | None
    lower: float | None
    upper: float | None

    @staticmethod
    def fit(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> "IqrFilter":
        q1, q3, lo, hi = iqr_fences(df, column, k, exact)
        return IqrFilter(column, q1, q3, lo, hi)

    def is_outlier(self) -> Column:
        if self.lower is None:
            return F.lit(False)
        x = q(self.column).cast("double")
        return F.coalesce((x < F.lit(self.lower)) | (x > F.lit(self.upper)), F.lit(False))

    def keep(self, df: DataFrame) -> DataFrame:
        return df.where(~self.is_outlier())

    def removed(self, df: DataFrame) -> DataFrame:
        return df.where(self.is_outlier())
