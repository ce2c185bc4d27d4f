"""All of the engine's registered queries and their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from lumenfold.operators.frame import Frame

_MODULES = ("tpch", "groupjoin", "frames", "joining", "grouping", "aggregates", "windows", "scalars", "text", "times", "nested", "arrays", "naming", "memory", "facts", "functions", "files", "streams")
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``, which returns a frame or a DataFrame, under ``name``; ``sql`` is its DuckDB twin."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.spark() if isinstance(out, Frame) else out

        run.__name__ = name
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable]:
    """Query functions by name."""
    for m in _MODULES:
        importlib.import_module(f"lumenfold.plans.{m}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    queries()
    return dict(_SQL)
