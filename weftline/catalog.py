"""Registry of the library's queries on the driver tables, and the SQL that each is checked against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    """Register a query; sql is None where no SQL oracle can express it."""
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def _load() -> None:
    """Import every module of weftline.plans; each registers its queries."""
    from weftline import plans

    for m in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        importlib.import_module(f"weftline.plans.{m.name}")
