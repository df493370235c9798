"""Which values break an expectation most often.

The exact answer counts every offending value. To count only those that can
be among the first, every task keeps a summary of at most ``COUNTERS``
values per file and expectation (Misra and Gries): when there are more, all
counters go down by the next largest one and the loss is noted. Summaries
add up: a value's counters over all tasks are at most its true count, and
fall short of it by no more than the losses.

A value can be among the first ``k`` only if its counters and the losses
reach the k-th largest counter. These survivors are counted exactly in one
more pass over the rows. Where the losses alone reach the k-th counter
(very many values, all rare), a value without any counter might belong too,
and the file and expectation is counted in full instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.quality import Expectation
from cadenza.session import checkpoint

#: Values a task's summary holds per file and expectation.
COUNTERS = 256
_KEY = ["expectation", "value"]


def offending_values(df: DataFrame, suite: list[Expectation], by: list[str]) -> DataFrame:
    """A row for each broken expectation of each row: ``by``, its name and
    the offending value as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found = F.array_compact(F.array(*(
        F.when(~e.passes(types[e.column]), F.struct(F.lit(e.name).alias("expectation"),
                                                    F.col(e.column).cast("string").alias("value")))
        for e in suite)))
    return df.select(*by, F.inline(found))


def summarised(rows: pd.DataFrame, by: list[str], held: pd.DataFrame | None, counters: int) -> pd.DataFrame:
    """A task's summary after some more rows: ``n`` per value, and ``loss``
    per group (on the row whose ``mark`` is set)."""
    group = [*by, "expectation"]
    new = rows.assign(n=1, loss=0, mark=False)
    every = pd.concat([held, new], ignore_index=True) if held is not None else new
    every = every.groupby([*by, *_KEY, "mark"], dropna=False, as_index=False)[["n", "loss"]].sum()
    marks, values = every[every["mark"]], every[~every["mark"]]
    place = values.groupby(group, dropna=False)["n"].rank(method="first", ascending=False)
    over = values[place == counters + 1][[*group, "n"]].rename(columns={"n": "cut"})
    if not len(over):
        return every
    values = values.merge(over, on=group, how="left")
    values["n"] = values["n"] - values["cut"].fillna(0).astype("int64")
    values = values[values["n"] > 0].drop(columns="cut")
    lost = over.rename(columns={"cut": "loss"}).assign(value=None, mark=True, n=0)
    marks = pd.concat([marks, lost], ignore_index=True).groupby([*by, *_KEY, "mark"], dropna=False, as_index=False)[
        ["n", "loss"]].sum()
    return pd.concat([values, marks], ignore_index=True)


def summaries(long: DataFrame, by: list[str], counters: int = COUNTERS) -> DataFrame:
    """Every task's summary of its offending values."""
    columns = [*by, *_KEY, "mark", "n", "loss"]

    def run(batches: Iterator[pd.DataFrame]):
        held = None
        for rows in batches:
            if len(rows):
                held = summarised(rows, by, held, counters)
        if held is not None:
            yield held[columns]

    kinds = ", ".join(f"`{c}` {long.schema[c].dataType.simpleString()}" for c in by)
    return long.select(*by, *_KEY).mapInPandas(
        run, f"{kinds}, expectation string, value string, mark boolean, n bigint, loss bigint")


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that may be null; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = left.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    return joined.drop(*(f"_{k}" for k in keys))


def frequent_values(df: DataFrame, suite: list[Expectation], by: str | list[str], k: int = 10,
                    counters: int = COUNTERS) -> DataFrame:
    """The ``k`` most frequent offending values of every file and
    expectation: ``by, expectation, rank, value, n_rows``, exactly; ties go
    to the smaller value, null last."""
    by = [by] if isinstance(by, str) else list(by)
    group = [*by, "expectation"]
    long = offending_values(df, suite, by)
    parts = checkpoint(summaries(long, by, counters))
    low = parts.filter("NOT mark").groupBy(*by, *_KEY).agg(F.sum("n").alias("low"))
    loss = parts.groupBy(*group).agg(F.sum("loss").alias("loss"))
    place = Window.partitionBy(*group).orderBy(F.col("low").desc(), F.col("value").asc_nulls_last())
    kth = low.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= k) \
        .groupBy(*group).agg(F.when(F.count(F.lit(1)) == k, F.min("low")).otherwise(0).alias("least"))
    bounds = _on(loss, kth, group, "left").withColumn("least", F.coalesce("least", F.lit(0)))
    bounds = checkpoint(bounds.withColumn("full", (F.col("loss") > 0) & (F.col("loss") >= F.col("least"))))
    survivors = _on(low, bounds.filter("NOT full").select(*group, "loss", "least"), group, "inner") \
        .filter(F.col("low") + F.col("loss") >= F.col("least")).select(*by, *_KEY)
    kept = _on(long, survivors, [*by, *_KEY], "left_semi")
    rest = _on(long, bounds.filter("full").select(*group), group, "left_semi")
    counted = kept.unionByName(rest).groupBy(*by, *_KEY).agg(F.count(F.lit(1)).alias("n_rows"))
    best = Window.partitionBy(*group).orderBy(F.col("n_rows").desc(), F.col("value").asc_nulls_last())
    return counted.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k) \
        .select(*group, "rank", "value", "n_rows")
