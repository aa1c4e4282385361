"""Registry of named queries and their SQL checks."""

from __future__ import annotations

from importlib import import_module

_RUN: dict = {}
_SQL: dict = {}

_SECTIONS = ("shaping", "scores", "screens", "summaries", "ranks", "tests", "measurement", "multivariate", "learning")


def query(name: str, sql: str | None = None):
    """Register ``run(spark, folder) -> DataFrame`` under ``name``."""

    def keep(run):
        if name in _RUN:
            raise ValueError(f"query {name} registered twice")
        _RUN[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return keep


def _load() -> None:
    for section in _SECTIONS:
        import_module(f"surveyloom.plans.{section}")


def queries() -> dict:
    _load()
    return dict(_RUN)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
