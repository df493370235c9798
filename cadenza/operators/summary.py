"""Summaries: counts and means, mean of means, bounds, distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_summary(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Row count and mean score (per group when ``by`` is given)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.avg(score).alias("mean_score")]
    return df.groupBy(*(by or [])).agg(*aggs)


def mean_of_means(df: DataFrame, score: str, batch: list[str], by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of per-batch means; both levels are partial
    aggregates, so no batch is ever gathered in one place."""
    by = by or []
    inner = df.groupBy(*by, *batch).agg(F.avg(score).alias("_m"))
    return inner.groupBy(*by).agg(F.avg("_m").alias("mean_of_means"),
                                  F.count(F.lit(1)).alias("n_batches"))


def bounds(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row of min/max per column (slider bounds)."""
    return df.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def distinct_values(df: DataFrame, col: str, first_seen_by: str | None = None) -> DataFrame:
    """Distinct non-missing values; with ``first_seen_by`` each value
    carries its first position so callers can order by first appearance."""
    d = df.filter(F.col(col).isNotNull())
    if first_seen_by:
        return d.groupBy(col).agg(F.min(first_seen_by).alias("first_seen"))
    return d.select(col).distinct()
