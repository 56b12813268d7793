"""Registry of named queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB oracle SQL over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ids: str  # SURVEY section-2 identifiers covered


QUERIES: dict[str, Query] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the plan modules fills the registry.
    from . import (q_posts, q_landing, q_history, q_requests, q_text,  # noqa: F401
                   q_models, q_streaming, q_hooks)
    return QUERIES
