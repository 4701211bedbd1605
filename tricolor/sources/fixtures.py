"""Derived tables used by the registered queries, each with its DuckDB SQL twin.

* ``docs_features``: per-document features computed from the whole text (no prefix):
  ``n_chars``, ``nonletter_share`` = 1 - letters / characters,
  ``word_share`` = distinct whitespace tokens / tokens; text is dropped before any join.
* ``docs_task``: features joined to ``labels`` (target ``quality``), ``row_id`` by ``doc_id``.
* ``docs_nulls``: features LEFT JOIN labels (unlabelled documents have NULL targets).
* ``li_label``: lineitem with ``label`` = 0 for ``l_linestatus`` 'F', 1 for 'O'.
* ``scored``: docs_task plus a deterministic md5 score (has errors and ties).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tricolor.functions.hashing import hash_uniform, sql_hash_uniform
from tricolor.sources.readers import table
from tricolor.sources.rowid import add_row_id

# The token separators and the letter class of the text features.
TOKEN_SPLIT = "[ \n\t]+"
NON_LETTER = "[^\\p{L}]"
SQL_TOKEN_SPLIT = "'[ ' || chr(10) || chr(9) || ']+'"
SQL_NON_LETTER = "'[^\\p{L}]'"

# Features are rounded to 6 places so both engines start from identical values.
FEATURE_DIGITS = 6
FEATURES = ["n_chars", "nonletter_share", "word_share"]
CATEGORICAL = ["lang", "source"]
TARGET = "quality"


def docs_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    toks = F.split(F.col("text"), TOKEN_SPLIT)
    letters = F.length(F.regexp_replace(F.col("text"), NON_LETTER, ""))
    return d.select(
        "doc_id", "lang", "source",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.round(F.lit(1.0) - F.try_divide(letters.cast("double"), F.length("text").cast("double")),
                FEATURE_DIGITS).alias("nonletter_share"),
        F.round(F.try_divide(F.size(F.array_distinct(toks)).cast("double"), F.size(toks).cast("double")),
                FEATURE_DIGITS).alias("word_share"))


SQL_DOCS_FEATURES = f"""
SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS n_chars,
       round(1.0 - CAST(length(regexp_replace(text, {SQL_NON_LETTER}, '', 'g')) AS DOUBLE)
             / nullif(CAST(length(text) AS DOUBLE), 0), 6) AS nonletter_share,
       round(CAST(len(list_distinct(string_split_regex(text, {SQL_TOKEN_SPLIT}))) AS DOUBLE)
             / nullif(CAST(len(string_split_regex(text, {SQL_TOKEN_SPLIT})) AS DOUBLE), 0), 6) AS word_share
FROM documents"""


def docs_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = docs_features(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    return add_row_id(f.join(lab, "doc_id"), ["doc_id"])


SQL_DOCS_TASK = f"""
SELECT row_number() OVER (ORDER BY f.doc_id) AS row_id, f.doc_id, f.lang, f.source,
       f.n_chars, f.nonletter_share, f.word_share, CAST(l.quality AS BIGINT) AS quality
FROM ({SQL_DOCS_FEATURES}) f JOIN labels l ON f.doc_id = l.doc_id"""


def docs_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = docs_features(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))
    return add_row_id(f.join(lab, "doc_id", "left"), ["doc_id"])


SQL_DOCS_NULLS = f"""
SELECT row_number() OVER (ORDER BY f.doc_id) AS row_id, f.doc_id, f.lang, f.source,
       f.n_chars, f.nonletter_share, f.word_share,
       CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
FROM ({SQL_DOCS_FEATURES}) f LEFT JOIN labels l ON f.doc_id = l.doc_id"""


def li_label(spark: SparkSession, sf_dir: str, with_row_id: bool = False) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "l_returnflag",
                    F.when(F.col("l_linestatus") == "F", F.lit(0)).when(F.col("l_linestatus") == "O", F.lit(1))
                    .cast("bigint").alias("label"))
    return add_row_id(out) if with_row_id else out


SQL_LI_LABEL = """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
       CAST(CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS BIGINT) AS label
FROM lineitem"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs_task(spark, sf_dir)
    score = F.round(F.lit(0.3) * F.col("quality") + F.lit(0.7) * hash_uniform("score", F.col("doc_id")), 2)
    return t.select("*", score.alias("score")).select(
        "*", (F.col("score") >= F.lit(0.5)).cast("int").alias("pred"))


SQL_SCORED = f"""
SELECT *, CAST(score >= 0.5 AS INTEGER) AS pred FROM (
  SELECT t.*, round(0.3 * t.quality + 0.7 * {sql_hash_uniform('score', 't.doc_id')}, 2) AS score
  FROM ({SQL_DOCS_TASK}) t)"""
