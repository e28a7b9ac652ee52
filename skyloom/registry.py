"""All queries of the library by name, with their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("composite", "night", "stencils", "projections", "catalogue", "vectors", "camera", "blends", "procedural", "kernels", "scalars")


def query(name: str, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query, with DuckDB SQL over the raw tables and the named oracle views."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            from .plans.oracle_views import with_views

            _ORACLES[name] = with_views(oracle, views)
        return f

    return put


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"skyloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
