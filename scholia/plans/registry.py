"""Named queries, each an operator bound to the supplied tables, with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Name a SQL subquery so that any twin which mentions it gets it as a CTE."""
    _VIEWS[name] = sql.strip()


def _needed(sql: str, found: dict[str, None]) -> None:
    for name, body in _VIEWS.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(body, found)
            found[name] = None


def with_views(sql: str) -> str:
    found: dict[str, None] = {}
    _needed(sql, found)
    sql = sql.strip()
    if not found:
        return sql
    ctes = ",\n".join(f"{name} AS (\n{_VIEWS[name]}\n)" for name in found)
    if re.match(r"(?i)with\s+recursive\s", sql):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with\s+recursive\s+", "", sql)
    if re.match(r"(?i)with\s", sql):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\s+", "", sql)
    return f"WITH {ctes}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` and, where SQL can say it, its twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap
