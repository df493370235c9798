"""Text search on a catalogue through a table of trigrams.

A text contains a needle only if it contains every run of three letters of
it. The posting table has a row for each distinct run and item, in order of
the run, so that a search for a few runs reads few row groups. Items that
have all runs of a needle are candidates (a count per item and needle), and
the exact test runs on the candidates alone. Needles of fewer than three
letters have no run; they are tested against every text.

The exact test is :func:`cadenza.functions.predicates.contains_ci`: lower
case on both sides, a missing text matches nothing, and the empty needle
every text that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.predicates import contains_ci

GRAM = 3
#: Rows of a row group of the posting table, so that a run lies in few.
GROUP_BYTES = 1 << 20


def grams(text: str | Column) -> Column:
    """The distinct runs of ``GRAM`` letters of a text in lower case."""
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    last = F.char_length(t) - (GRAM - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(GRAM)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``gram, id`` rows."""
    return df.filter(F.col(text_col).isNotNull()).select(F.explode(grams(text_col)).alias("gram"),
                                                         F.col(id_col).alias("id")).distinct()


def save_postings(df: DataFrame, id_col: str, text_col: str, path: str, parts: int | None = None) -> None:
    """Write the posting table in order of the runs. A run in a third of all
    texts spreads over several parts: the id is part of the order."""
    rows = postings(df, id_col, text_col)
    ranged = rows.repartitionByRange(parts, "gram", "id") if parts else rows.repartitionByRange("gram", "id")
    ranged.sortWithinPartitions("gram", "id").write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def candidates(stored: DataFrame, needles: list[str]) -> DataFrame:
    """``needle, id`` of items that have every run of a needle of at least
    ``GRAM`` letters. The needles' runs reach the scan as a list."""
    runs = {n: sorted({n.lower()[i:i + GRAM] for i in range(len(n.lower()) - GRAM + 1)}) for n in needles}
    runs = {n: r for n, r in runs.items() if r}
    spark = stored.sparkSession
    wanted = spark.createDataFrame([(n, g, len(r)) for n, r in runs.items() for g in r],
                                   "needle string, gram string, of int")
    found = stored.filter(F.col("gram").isin(sorted({g for r in runs.values() for g in r}) or [""]))
    # a row for each run of each needle: bounded by the request
    hits = found.join(F.broadcast(wanted), "gram").groupBy("needle", "id").agg(
        F.count(F.lit(1)).alias("n"), F.first("of").alias("of"))
    return hits.filter(F.col("n") == F.col("of")).select("needle", "id")


def search(df: DataFrame, id_col: str, text_col: str, stored: DataFrame, needles: list[str]) -> DataFrame:
    """``needle`` and the columns of ``df`` of every item whose text
    contains it. ``stored`` is the posting table of ``df``."""
    needles = list(dict.fromkeys(needles))
    short = [n for n in needles if len(n.lower()) < GRAM]
    long = [n for n in needles if len(n.lower()) >= GRAM]
    text = F.lower(F.col(text_col))
    near = candidates(stored, long)
    out = df.join(near.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id")) \
        .filter(F.coalesce(F.contains(text, F.lower("needle")), F.lit(False))).select("needle", *df.columns)
    for n in short:
        out = out.unionByName(df.filter(contains_ci(text_col, n)).select(F.lit(n).alias("needle"), *df.columns))
    return out


def open_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
