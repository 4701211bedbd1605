"""Fitted column transforms: min-max and standard scaling, derived features.

Fit = one aggregate for all columns; apply = one projection (works on batch or stream).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.functions.scalar import default_feature_name, feature_expr
from tricolor.operators.profile import q


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns])


@dataclass(frozen=True)
class MinMaxScaling:
    """(x - min) / (max - min); a constant column divides by 1 (-> 0 on train). No clipping."""

    stats: tuple  # ((column, min, max), ...)

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> "MinMaxScaling":
        cols = list(columns)
        r = df.agg(*[F.min(q(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cols)],
                   *[F.max(q(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
        return MinMaxScaling(tuple((c, r[f"mn{i}"], r[f"mx{i}"]) for i, c in enumerate(cols)))

    def exprs(self) -> dict[str, Column]:
        out = {}
        for c, mn, mx in self.stats:
            if mn is None:
                continue
            rng = (mx - mn) if mx != mn else 1.0
            out[c] = (q(c).cast("double") - F.lit(mn)) / F.lit(rng)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, {c: e for c, e in self.exprs().items() if c in df.columns})


@dataclass(frozen=True)
class StandardScaling:
    """(x - mean) / population std; a zero std is treated as 1."""

    stats: tuple  # ((column, mean, std_pop), ...)

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str]) -> "StandardScaling":
        cols = list(columns)
        r = df.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.stddev_pop(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return StandardScaling(tuple((c, r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)))

    def exprs(self) -> dict[str, Column]:
        out = {}
        for c, m, s in self.stats:
            if m is None:
                continue
            sd = s if (s is not None and s > 0.0) else 1.0
            out[c] = (q(c).cast("double") - F.lit(m)) / F.lit(sd)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return _replace(df, {c: e for c, e in self.exprs().items() if c in df.columns})


@dataclass(frozen=True)
class NewFeature:
    """A derived column from one of the fixed operations (Add, Subtract, ..., Square)."""

    op: str
    col1: str
    col2: str | None = None
    name: str | None = None

    @property
    def out(self) -> str:
        return self.name or default_feature_name(self.op, self.col1, self.col2)

    def expr(self) -> Column:
        return feature_expr(self.op, self.col1, self.col2)

    def transform(self, df: DataFrame) -> DataFrame:
        needed = [self.col1] + ([self.col2] if self.col2 else [])
        if any(c not in df.columns for c in needed):
            return df  # replay skips a step whose inputs are absent
        return df.select(*[q(c) for c in df.columns if c != self.out], self.expr().alias(self.out))
