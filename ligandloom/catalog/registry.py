"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ligandloom.catalog.views import VIEW_SQL, VIEW_USES


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _with_views(body: str, views: str) -> str:
    names: list[str] = []

    def need(name: str) -> None:
        for other in VIEW_USES.get(name, ()):
            need(other)
        if name not in names:
            names.append(name)

    for name in views.split():
        need(name)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, views: str = "", sql: str | None = None):
    """Register a Spark query and its SQL over the named views."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = Query(fn, None if sql is None else _with_views(sql, views))
        return fn

    return add


def r(expr: str, digits: int) -> str:
    """SQL of ``values.half_even``."""
    scale = f"{10**digits}::DOUBLE"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"
