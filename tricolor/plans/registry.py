"""Registry of named queries (one per operator) and their DuckDB SQL oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle, when the operator has a SQL
form, is a string DuckDB runs on the same parquet tables (registered as views). Double
columns of every Spark result are rounded to 6 places; the SQL rounds the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tricolor.sources.sinks import round_doubles

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    """Register ``fn`` under ``name`` (with its SQL twin, if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (registration happens at import)."""
    from tricolor.plans import q_models, q_prepare, q_relational  # noqa: F401


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
