"""Registry of the library's queries: what runs in Spark, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_MODULES = ("plans.text_queries", "plans.search_queries", "plans.analytics_queries", "plans.state_queries", "plans.dataset_queries", "plans.account_queries", "plans.prompt_queries", "plans.evaluation_queries", "plans.upkeep_queries", "plans.dense_queries")


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)``; ``sql`` is DuckDB SQL over the same tables, where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load() -> None:
    for m in _MODULES:
        import_module(f"corpuskiln.{m}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
