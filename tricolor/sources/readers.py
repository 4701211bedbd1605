"""Readers: CSV, JSON, parquet, the sample catalogue and the driver's tables.

Missing values are normalised once at ingest so NULL is the only marker afterwards:
floating NaN becomes NULL and the strings a pandas reader treats as missing become NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricolor.sources.json_array import read_array

# The strings pandas' CSV reader reads as missing by default.
PANDAS_NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Sample names, formats and roles offered by the sample catalogue.
SAMPLE_NAMES = [
    "titanic", "heart_disease", "breast cancer", "creditcard", "diabetes", "banknote",
    "creditcard 1to100", "creditcard 10to100", "creditcard 50to50",
]
SAMPLE_FORMATS = ["csv", "xlsx", "json"]
SAMPLE_ROLES = ["train", "test"]

# Names of the driver's parquet tables.
DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def normalize_missing(df: DataFrame, na_strings: list[str] | None = None) -> DataFrame:
    """NaN -> NULL for float columns, pandas NA strings -> NULL for string columns (one select)."""
    na = PANDAS_NA_STRINGS if na_strings is None else na_strings
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and na:
            cols.append(F.when(c.isin(na), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast string columns; a value that does not fit its declared type is an error, as on reading."""
    return raw.select(*[F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType)
                        else F.trim(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             normalize: bool = True) -> DataFrame:
    """Headed CSV. Pass ``schema`` at scale; without it types are inferred (an extra pass).

    The missing markers are values of every column: all columns are read as strings, the markers
    become NULL, and only then are values typed, so ``NA`` in a number column is a missing number.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if not normalize:
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    if schema is not None:
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        raw = normalize_missing(reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path))
        return normalize_missing(_typed(raw, schema))
    raw = normalize_missing(reader.csv(path))
    return normalize_missing(_typed(raw, infer_types(raw)))


# The types tried in turn; the first that fits every value is the column's.
CSV_TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def infer_types(raw: DataFrame) -> T.StructType:
    """The narrowest type of each string column that holds all its values (NULLs aside), in one
    aggregate over the table; a column without values stays a string."""
    if not raw.columns:
        return T.StructType([])
    aggs = []
    for i, c in enumerate(raw.columns):
        v = F.trim(F.col(f"`{c}`"))
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count_if(v.isNotNull() & v.try_cast(t).isNull()).alias(f"bad{i}_{t}") for t in CSV_TYPES]
    r = raw.agg(*aggs).first()
    kinds = [next((t for t in CSV_TYPES if r[f"n{i}"] and not r[f"bad{i}_{t}"]), "string") for i in range(len(raw.columns))]
    return T.StructType.fromDDL(", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in zip(raw.columns, kinds)))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multiline: bool = False, columns: list[str] | None = None,
              normalize: bool = True) -> DataFrame:
    """JSON Lines by default; ``multiline=True`` for an array of records in each file, which is
    read by byte ranges as well (``json_array``).

    JSON inference orders columns alphabetically, so the declared order is re-selected.
    """
    if multiline:
        df = read_array(spark, path, schema)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    order = columns or (schema.fieldNames() if isinstance(schema, T.StructType) else None)
    if order:
        df = df.select(*[F.col(f"`{c}`") for c in order])
    return normalize_missing(df) if normalize else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, schema)
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt == "parquet":
        return normalize_missing(spark.read.parquet(path))
    if fmt == "xlsx":
        raise ValueError("xlsx is not read on Spark: convert it to CSV or parquet first")
    raise ValueError(f"unsupported format: {fmt}")


@dataclass(frozen=True)
class SampleCatalog:
    """Resolves ``name`` x ``format`` x ``role`` to ``{base}/{fmt}/{name} {role}.{fmt}``."""

    base_dir: str

    def path(self, name: str, fmt: str = "csv", role: str = "train") -> str:
        if name not in SAMPLE_NAMES:
            raise ValueError(f"unknown sample {name!r}; choose one of {SAMPLE_NAMES}")
        if fmt not in SAMPLE_FORMATS:
            raise ValueError(f"unknown format {fmt!r}; choose one of {SAMPLE_FORMATS}")
        if role not in SAMPLE_ROLES:
            raise ValueError(f"unknown role {role!r}; choose one of {SAMPLE_ROLES}")
        return f"{self.base_dir.rstrip('/')}/{fmt}/{name} {role}.{fmt}"

    def load(self, spark: SparkSession, name: str, fmt: str = "csv", role: str = "train",
             schema: T.StructType | None = None) -> DataFrame:
        return read_table(spark, self.path(name, fmt, role), fmt, schema)


@dataclass(frozen=True)
class TableCatalog:
    """The driver's parquet tables: ``{sf_dir}/{name}.parquet``."""

    sf_dir: str

    def path(self, name: str) -> str:
        if name not in DRIVER_TABLES:
            raise ValueError(f"unknown table {name!r}")
        return f"{self.sf_dir.rstrip('/')}/{name}.parquet"

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TableCatalog(sf_dir).load(spark, name)
