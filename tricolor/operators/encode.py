"""One-hot encoding with the first (sorted) category dropped, fitted once.

Categories per string column are fitted on training data (distinct (column, value) pairs,
with a checked bound) and test data is always encoded with the fitted list, never its own.
NULL encodes as all zeros; an unseen category also encodes as all zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.profile import boolean_columns, q, string_columns
from tricolor.sources.rowid import ordered_rank

MAX_CATEGORIES = 1000
_NULL_CHECK = "\u0000null-check"


class NullValuesError(ValueError):
    pass


@dataclass(frozen=True)
class OneHotEncoding:
    columns: tuple[str, ...]
    categories: dict = field(default_factory=dict)   # column -> sorted tuple of categories

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str] | None = None,
            max_categories: int = MAX_CATEGORIES, require_not_null: str | None = None) -> "OneHotEncoding":
        """Fit the sorted categories of ``columns``. ``require_not_null`` names a column that must
        hold no NULL (e.g. the mapped target); it is checked in the same job, not a pass of its own."""
        cols = list(columns) if columns is not None else string_columns(df)
        entries = [F.struct(F.lit(c).alias("k"), q(c).cast("string").alias("v")) for c in cols]
        if require_not_null:
            entries.append(F.struct(F.lit(_NULL_CHECK).alias("k"),
                                    F.when(q(require_not_null).isNull(), F.lit("null")).alias("v")))
        if not entries:
            return OneHotEncoding(tuple(), {})
        pairs = df.select(F.explode(F.array(*entries)).alias("p"))
        pairs = pairs.select("p.k", "p.v").where(F.col("v").isNotNull()).distinct()
        bound = max_categories * len(cols) + 2
        rows = pairs.limit(bound).collect()
        if any(r["k"] == _NULL_CHECK for r in rows):
            raise NullValuesError(f"{require_not_null!r} has NULL or unmapped values")
        cats: dict[str, list] = {c: [] for c in cols}
        for r in rows:
            cats[r["k"]].append(r["v"])
        for c, vs in cats.items():
            if len(vs) > max_categories or len(rows) >= bound - 1:
                raise ValueError(f"one-hot: column {c!r} exceeds {max_categories} categories")
        return OneHotEncoding(tuple(cols), {c: tuple(sorted(v)) for c, v in cats.items()})

    def output_columns(self, c: str) -> list[str]:
        return [f"{c}_{v}" for v in self.categories.get(c, ())[1:]]

    def feature_names(self, df_columns: Sequence[str]) -> list[str]:
        out = []
        for c in df_columns:
            if c in self.columns:
                out += self.output_columns(c)
            else:
                out.append(c)
        return out

    def transform(self, df: DataFrame, bool_to_double: bool = True) -> DataFrame:
        """Replace each fitted string column by its dummy columns (double), in place."""
        bools = set(boolean_columns(df)) if bool_to_double else set()
        out = []
        for c in df.columns:
            if c in self.columns:
                x = q(c).cast("string")
                for v in self.categories.get(c, ())[1:]:
                    out.append(F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}"))
            elif c in bools:
                out.append(q(c).cast("double").alias(c))
            else:
                out.append(q(c))
        return df.select(*out)

    def table(self, spark) -> DataFrame:
        rows = [(c, i, v, i > 0) for c in self.columns for i, v in enumerate(self.categories.get(c, ()))]
        return spark.createDataFrame(rows, "column string, position int, category string, kept boolean")


def sparse_onehot(df: DataFrame, columns: Sequence[str], id_col: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """One-hot for any number of categories: (categories, rows).

    ``categories`` is the relation (column, category, position) with the first category of each
    column left out; ``rows`` has (id, active), the sorted positions that are 1. Categories are
    ranked and joined by Spark, so neither a column per category nor a driver-side list is needed.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("category")) for c in columns])
    long = df.select(q(id_col), F.explode(cells).alias("e")).select(id_col, "e.column", "e.category")
    known = long.where(F.col("category").isNotNull()).select("column", "category").distinct()
    first = known.groupBy("column").agg(F.min("category").alias("category"))
    kept = ordered_rank(known.join(first, ["column", "category"], "left_anti"), [F.col("column"), F.col("category")], "_p")
    kept = kept.select("column", "category", (F.col("_p") - 1).alias("position"))
    active = (long.join(kept, ["column", "category"], "left").groupBy(id_col)
              .agg(F.sort_array(F.collect_list("position")).alias("active")))
    return kept, active
