"""Summaries kept up to date, file by file.

Every file leaves its partial aggregates (count, sum, least, greatest per
group) in a folder, with the fingerprint of the file they were made from. A
summary adds up the partial aggregates of each file's last fingerprint, so
a file that arrives is read once, a file that changes takes its old part
back by being read again, and no other file is read.

States are only ever added, each commit in a folder of its own version, and
a version is complete or not there (Spark renames its output into place and
marks it); a commit that is made twice under one version replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.merge import new_files


def states(rows: DataFrame, file_col: str, by: list[str], value: str) -> DataFrame:
    """Partial aggregates per file and group; null values count as rows."""
    v = F.col(value)
    return rows.groupBy(F.col(file_col).alias("filename"), *by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_values"), F.sum(v).alias("total"),
        F.min(v).alias("least"), F.max(v).alias("greatest"))


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(files taken, states) of all versions; None before the first."""
    base = folder.rstrip("/")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/files")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None, None
    return spark.read.parquet(f"{base}/files"), spark.read.parquet(f"{base}/states")


def pending(spark: SparkSession, folder: str, listing: DataFrame) -> DataFrame:
    """Listed files (``filename, fingerprint``) that are new or changed."""
    files, _ = stored(spark, folder)
    return listing if files is None else new_files(listing, files, order=["version"])


def take(spark: SparkSession, folder: str, listing: DataFrame, rows: DataFrame, file_col: str, by: list[str],
         value: str, version: int) -> None:
    """Add the states of the listed files, whose rows are given. The files
    are noted last: states without their note are not read."""
    base = folder.rstrip("/")
    part = states(rows, file_col, by, value).join(listing.select("filename", "fingerprint"), "filename")
    part.write.mode("overwrite").parquet(f"{base}/states/version={version}")
    listing.select("filename", "fingerprint").write.mode("overwrite").parquet(f"{base}/files/version={version}")


def summary(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """``n_rows, n_values, total, least, greatest, mean`` per group over the
    last state of every file."""
    files, parts = stored(spark, folder)
    if files is None:
        raise ValueError(f"no states in {folder}")
    last = files.groupBy("filename").agg(F.max("version").alias("version"))
    kept = parts.join(last, ["filename", "version"], "left_semi")
    out = kept.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"),
                                F.sum("total").alias("total"), F.min("least").alias("least"),
                                F.max("greatest").alias("greatest"))
    return out.withColumn("mean", F.col("total") / F.col("n_values"))
