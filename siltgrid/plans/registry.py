"""Registry of the library's queries: name -> callable and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_QUERIES: dict[str, Callable[..., Any]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def _loaded() -> None:
    from . import column_queries, composite_queries, contract_queries, fitting_queries, overlay_queries, raster_queries, relational_queries, selection_queries, source_queries, spatial_queries, temporal_queries, tracing_queries, vector_queries  # noqa: F401  register their queries


def queries() -> dict[str, Callable[..., Any]]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_ORACLES)


def flagship(spark, sf_dir: str):
    """Otsu thresholds, masks, cleanup and accuracy of the pixel scenes."""
    return queries()["flagship_scene_accuracy"](spark, sf_dir)
