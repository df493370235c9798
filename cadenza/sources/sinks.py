"""Sinks: history append, CSV export, counted copy. The keyed table is in
``keyed_table``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def history_path(path: str, kind: str) -> str:
    """The folder of one kind of results; kinds differ in their columns."""
    return f"{path.rstrip('/')}/{kind}"


def append_history(df: DataFrame, path: str, kind: str, ts_col: str = "created_at",
                   fmt: str = "parquet") -> None:
    """Append result rows to the history of their kind, partitioned by the
    day of ``ts_col``, so history reads prune to the days they ask for."""
    out = df.withColumn("day", F.to_date(ts_col))
    out.write.mode("append").partitionBy("day").format(fmt).save(history_path(path, kind))


def read_history(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """All stored results of one kind, with their ``day``."""
    return spark.read.format(fmt).load(history_path(path, kind))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header line."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def copy_with_count(df: DataFrame, path: str, fmt: str = "csv") -> int:
    """Copy rows to ``path`` and return the row count, observed during the
    write itself (no second pass)."""
    obs = Observation("copy")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    w = observed.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    w.format(fmt).save(path)
    return int(obs.get["rows"])


def scan_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Full scan of a stored table."""
    return spark.read.format(fmt).load(path)
