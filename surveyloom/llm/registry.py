"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, folder) -> DataFrame`` under ``name``."""

    def keep(run):
        _RUN[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import_module("surveyloom.llm.queries")
    return dict(_RUN)


def oracle_sql() -> dict[str, str]:
    import_module("surveyloom.llm.queries")
    return dict(_SQL)
