"""The corpus pipeline: five stages over ``documents``, each one operator of ``tricolor.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tricolor.llm.common import drop_tables, load, stage_table
from tricolor.llm.mixing import mixed_documents
from tricolor.llm.near_dedup import drop_near_duplicates
from tricolor.llm.packing import pack
from tricolor.llm.substring_dedup import cut_repeats
from tricolor.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers reject go; it learns from the labels of the training folds."""
    return drop_toxic(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return drop_near_duplicates(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more stay in their first document only."""
    return cut_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the ratio 1 : 2 : 3 in turn; a document taken several times is several rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the permitted lengths."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("source_mixing", source_mixing), ("packing", packing)]

# Trained classifiers and hashed seeds have no SQL form; the stages are tested one by one against
# brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            done = stage_table(done, name)
            if i:
                drop_tables(spark, docs)   # the next stage reads what this one has written
        docs = done
    return docs
