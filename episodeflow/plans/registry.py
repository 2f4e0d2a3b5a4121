"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL).

Each query reads the driver tables of one scale-factor folder (or data
Spark derives from them) and returns a DataFrame. The oracle SQL, when
given, computes the same rows with the same column names.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Spec:
    key: str
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Spec] = {}


def register(key: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``ids`` names the SURVEY operator ids the query covers.
    """
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key!r}")
        REGISTRY[key] = Spec(key, fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Spec]:
    """Import every query module so that the registry is filled."""
    from episodeflow.plans import (  # noqa: F401
        queries_joins, queries_metrics, queries_ordering, queries_prompts,
        queries_responses, queries_select, queries_sources, queries_streaming,
    )
    return REGISTRY
