"""Access to the input tables (one Parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table lazily; Catalyst prunes columns and pushes filters
    into the Parquet scan."""
    path = os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet"
    return spark.read.parquet(path)
