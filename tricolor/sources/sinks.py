"""Sinks: headed CSV, JSON Lines, parquet, and the assembled final results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.operators.profile import q

PREDICTION_SUFFIXES = ("_Prediction", "_Prob", "_TrafficLight")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Headed CSV, no index column; one file per partition (a directory)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON Lines (one record per line) rather than one array: splittable on read."""
    df.write.mode(mode).json(path)
    return path


def write_json_arrays(df: DataFrame, path: str, rows_per_file: int = 10_000, mode: str = "overwrite") -> str:
    """One array of records in each file, of about ``rows_per_file`` rows: a task holds one array,
    so their number grows with the table. Equal rows are dealt by a random number, never together."""
    files = max(1, -(-df.count() // rows_per_file))
    arrays = (df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r"))
              .groupBy(F.floor(F.rand(0) * files).alias("file"))
              .agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value")))
    arrays.select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: Sequence[str] | None = None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export(df: DataFrame, path: str, fmt: str = "csv") -> str:
    if fmt == "csv":
        return write_csv(df, path)
    if fmt == "json":
        return write_json(df, path)
    if fmt == "parquet":
        return write_parquet(df, path)
    raise ValueError(f"unsupported export format {fmt!r}")


def assemble_results(df: DataFrame, id_col: str = "row_id",
                     original_cols: Sequence[str] = (), derived_cols: Sequence[str] = (),
                     pc_cols: Sequence[str] = (), model_prefixes: Sequence[str] = (),
                     include_original: bool = True, include_derived: bool = True,
                     include_pcs: bool = True, include_predictions: bool = True) -> DataFrame:
    """Final table: ``row_id`` first, optional originals, ``TF_``-prefixed derived columns,
    optional ``PC1..k``, then ``{prefix}_Prediction/_Prob/_TrafficLight`` per chosen model.
    Names absent from ``df`` are skipped; everything comes from one frame keyed by ``row_id``.
    """
    have = set(df.columns)
    out = [q(id_col)]
    if include_original:
        out += [q(c) for c in original_cols if c in have and c != id_col]
    if include_derived:
        out += [q(c).alias(f"TF_{c}") for c in derived_cols if c in have]
    if include_pcs:
        out += [q(c) for c in pc_cols if c in have]
    if include_predictions:
        for p in model_prefixes:
            out += [q(f"{p}{s}") for s in PREDICTION_SUFFIXES if f"{p}{s}" in have]
    return df.select(*out)


def head(df: DataFrame, n: int = 5, order_col: str = "row_id") -> DataFrame:
    """Preview: the first ``n`` rows by ``row_id`` (a distributed top-n, not a full sort)."""
    return df.orderBy(q(order_col)).limit(n)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used to compare results across engines)."""
    return df.select(*[F.round(q(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else q(f.name) for f in df.schema.fields])
