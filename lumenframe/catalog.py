"""Registry of the queries over the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of lumenframe.plans that hold queries: QUERIES maps a name to (function, SQL or None).
PLANS: tuple[str, ...] = ("aggregates", "windows", "joins", "search", "similar", "folds", "media", "analytics")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    found: dict = {}
    for name in PLANS:
        found |= importlib.import_module(f"lumenframe.plans.{name}").QUERIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to function(spark, sf_dir)."""
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL, of the queries that have it."""
    return {name: sql for name, (_, sql) in _all().items() if sql}
