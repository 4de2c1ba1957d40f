"""Registry of driver queries: name -> (spark builder, DuckDB oracle SQL or None).

A query is a function ``(spark, sf_dir) -> DataFrame`` over the given tables.  Its
oracle is an independent SQL text over the same tables (views with the table names);
``None`` marks an operator with no SQL form (iterative ML, difflib ratio, streams):
those are checked by row count here and against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # import for the registration side effect
    from ticketlake.plans import (  # noqa: F401
        q_kpi, q_prep, q_chat, q_retrieval, q_vectors, q_text, q_ml, q_stream, q_io,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
