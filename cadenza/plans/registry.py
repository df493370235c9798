"""Registry of named plans over the input tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the equivalent ANSI SQL over the same tables (omitted when the
    operator has no SQL form)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate plan {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that all plans are registered."""
    from cadenza.plans import (quality_plans, column_plans, merge_plans,  # noqa: F401
                               similarity_plans, history_plans, scoring_plans,
                               source_plans, summary_plans)
