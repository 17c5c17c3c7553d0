"""Names of queries, their functions and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable:
    """Registers a function (spark, sf_dir) under its name; ``sql`` may use the named views."""

    def register(f: Callable) -> Callable:
        name = f.__name__
        _queries[name] = f
        if sql:
            body = sql.strip()
            recursive = body.startswith("WITH RECURSIVE ")
            rest = body.removeprefix("WITH RECURSIVE " if recursive else "WITH ")
            named = [f"{v} AS ({VIEWS[v]})" for v in views.split()] + ([rest] if rest != body else [])
            own = ",\n".join(named)
            _sql[name] = f"WITH {'RECURSIVE ' if recursive else ''}{own}\n{body if rest == body else ''}" if named else body
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
