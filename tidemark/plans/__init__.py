"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from . import classifier, evaluation, graphs, market, memories, news, portfolios, scoring, storage, streams  # noqa: F401
from .registry import oracle_sql, queries  # noqa: F401
