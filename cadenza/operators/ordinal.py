"""Consecutive row positions inside groups, without one task per group.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends a whole group to
one task; when one file holds a third of all rows that task does a third
of the work. Here the rows are range-partitioned on (g, o), so a hot
group is spread over many tasks, each task numbers its own rows, and a
small table of per-(task, group) counts turns local numbers into global
ones. The numbered frame is checkpointed to the shared checkpoint folder
so that every consumer (and every retry after a lost executor) sees the
same task boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import checkpoint_dir


def ordinal(df: DataFrame, group_cols: list[str], order_cols: list[str],
            name: str = "rn", num_partitions: int | None = None,
            keep_task_ids: bool = False) -> DataFrame:
    """Add ``name``: 1-based position of each row in its group by
    ``order_cols``, which must be a total order inside the group. A null group key is a
    group of its own.
    ``keep_task_ids`` also keeps ``task_id``, the task that numbered the
    row (to inspect how a hot group was spread)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    keys = list(group_cols) + list(order_cols)
    local = (F.monotonically_increasing_id()
             - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    # without an explicit count AQE sizes the range partitions from the
    # measured shuffle (small inputs are not spread over 200 empty tasks);
    # numbering happens after that read, so it sees the final partitions
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    numbered = (ranged
                .sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_local", local)
                .checkpoint(eager=True))
    # one row per (task, group): bounded by tasks + groups
    spans = (numbered.groupBy("_pid", *group_cols)
             .agg(F.count(F.lit(1)).alias("_cnt"), F.min("_local").alias("_first")))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = spans.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    # null-safe: a null group key is a group like any other
    spans = spans.select(F.col("_pid").alias("_p"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)),
                         "_offset", "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group_cols)]
    out = numbered.join(spans, [F.col("_pid") == F.col("_p"), *same], "inner")
    out = out.withColumn(name, F.col("_offset") + F.col("_local") - F.col("_first") + 1)
    if keep_task_ids:
        out = out.withColumnRenamed("_pid", "task_id")
    return out.drop("_pid", "_local", "_offset", "_first", "_p", *(f"_g{i}" for i in range(len(group_cols))))
