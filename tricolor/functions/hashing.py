"""Reproducible randomness from md5, identical in Spark and DuckDB.

Every random choice (split, folds, sampling draws, SMOTE gaps) is a function of a seed and a
row key, so a plan gives the same rows on any partitioning and the SQL oracle can recompute it:

* order key  ``md5('<seed>:' || key)``                      (hex string, ties broken by key)
* uniform u  ``conv(substr(md5('<seed>:' || key), 1, 8), 16, 10) / 2^32``  in [0, 1)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, key) -> Column:
    """md5 hex of ``'<seed>:<key>'``; an order key that is uniform over rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def hash_uniform(seed, key) -> Column:
    """A uniform double in [0, 1) from the first 32 bits of the md5 order key."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def hash_int(seed, key) -> Column:
    """A uniform non-negative bigint in [0, 2^32)."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint")


def sql_hash_key(seed, key_sql: str) -> str:
    return f"md5('{seed}:' || CAST({key_sql} AS VARCHAR))"


def sql_hash_int(seed, key_sql: str) -> str:
    return f"CAST(('0x' || substr({sql_hash_key(seed, key_sql)}, 1, 8)) AS BIGINT)"


def sql_hash_uniform(seed, key_sql: str) -> str:
    return f"({sql_hash_int(seed, key_sql)} / 4294967296.0)"
