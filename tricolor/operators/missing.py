"""Missing-value treatment, fitted on training data and replayed on any other table.

A step is ``(method, column, value)``; ``mean`` / ``median`` values are fitted in one
aggregate for all such steps, then every step is a projection or a row filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricolor.operators.profile import q, quantile_table, quantile_values

METHODS = ("drop_rows", "drop_column", "zero", "mean", "median")


@dataclass(frozen=True)
class MissingStep:
    method: str
    column: str
    value: float | int | str | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown missing-value method {self.method!r}")


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def fit_missing(df: DataFrame, steps: Sequence[MissingStep], exact_median: bool = True) -> list[MissingStep]:
    """Resolve mean/median values on ``df`` (one aggregate); non-numeric columns are skipped."""
    wanted = [(i, s) for i, s in enumerate(steps)
              if s.method in ("mean", "median") and s.value is None
              and s.column in df.columns and _is_numeric(df, s.column)]
    out = list(steps)
    if wanted:
        means = [(i, s) for i, s in wanted if s.method == "mean"]
        if means:
            r = df.agg(*[F.avg(q(s.column).cast("double")).alias(f"v{i}") for i, s in means]).first()
            for i, s in means:
                out[i] = replace(s, value=r[f"v{i}"])
        medians = [(i, s) for i, s in wanted if s.method == "median"]
        if medians and exact_median:
            values = quantile_table(df, list(dict.fromkeys(s.column for _, s in medians)), (0.5,))  # one pass for all
            for i, s in medians:
                out[i] = replace(s, value=values[s.column][0])
        elif medians:
            for i, s in medians:
                (med,) = quantile_values(df, s.column, (0.5,), False)
                out[i] = replace(s, value=med)
    # mean / median on a non-numeric column is a no-op (skipped).
    return [s for s in out
            if not (s.method in ("mean", "median") and (s.column not in df.columns
                                                          or not _is_numeric(df, s.column)))]


def _fill_value(df: DataFrame, c: str, v, method: str) -> tuple:
    """(fill literal, result type).

    A column with missing values is floating point in the reference's frames, so a mean or
    median fill yields double; a zero fill keeps the column type (strings get "0").
    """
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return F.lit(str(v)), "string"
    if isinstance(dt, T.BooleanType):
        return F.lit(bool(v)), "boolean"
    if method in ("mean", "median"):
        return F.lit(float(v)), "double"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.lit(int(v)).cast(dt), dt.simpleString()
    return F.lit(float(v)), "double"


def apply_missing(df: DataFrame, steps: Sequence[MissingStep]) -> DataFrame:
    """Replay fitted steps in order; steps on absent columns are skipped."""
    for s in steps:
        if s.column not in df.columns:
            continue
        if s.method == "drop_rows":
            df = df.where(q(s.column).isNotNull())
        elif s.method == "drop_column":
            df = df.drop(s.column)
        else:
            v = 0 if s.method == "zero" else s.value
            if v is None:
                continue
            fill, typ = _fill_value(df, s.column, v, s.method)
            df = df.select(*[F.coalesce(q(c).cast(typ), fill.cast(typ)).alias(c) if c == s.column
                             else q(c) for c in df.columns])
    return df
