"""Keyed joins that replace positional alignment: inner align, semi, anti, concat by id,
bounded lookups and the wide per-model prediction row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def inner_align(x: DataFrame, y: DataFrame, key: str = "row_id") -> DataFrame:
    return x.join(y, key, "inner")


def keep_surviving(df: DataFrame, survivors: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(survivors.select(key), key, "left_semi")


def removed_rows(df: DataFrame, survivors: DataFrame, key: str = "row_id") -> DataFrame:
    return df.join(survivors.select(key), key, "left_anti")


def concat_by_id(frames: Sequence[DataFrame], key: str = "row_id") -> DataFrame:
    """Side-by-side concatenation by id (left joins on the first frame)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key, "left")
    return out


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Left join to a lookup table. Spark decides by the lookup's bytes whether it is broadcast."""
    return df.join(lookup, key, how)
