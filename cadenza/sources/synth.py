"""Synthetic catalogues and random splits, generated on the executors
(``spark.range`` + seeded ``rand``), never on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.schema import FULL_ARTISTS, FULL_GENRES, FULL_SONGS, SMALL_GENRES


def _uniform(seed: int, lo: float, hi: float, digits: int | None = None) -> Column:
    v = F.lit(lo) + F.rand(seed) * (hi - lo)
    return F.round(v, digits) if digits is not None else v


def _randint(seed: int, lo: int, hi: int) -> Column:
    """Uniform integer in [lo, hi]."""
    return (F.lit(lo) + F.floor(F.rand(seed) * (hi - lo + 1))).cast("int")


def _choice(seed: int, values: list[str]) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, _randint(seed, 1, len(values)))


def synth_tracks(spark: SparkSession, n: int, seed: int = 0, files: int = 10,
                 profile: str = "full") -> DataFrame:
    """Synthetic catalogue rows spread over ``files`` file names.

    ``full``: 18 columns, names like Song_42, uniform feature ranges.
    ``small``: 9 columns, unique names, narrower ranges."""
    s = seed * 1000
    base = spark.range(n)
    if profile == "small":
        return base.select(
            F.concat(F.lit("Artist "), F.col("id").cast("string")).alias("artist"),
            F.concat(F.lit("Song "), F.col("id").cast("string")).alias("song"),
            _randint(s + 1, 1990, 2022).alias("year"),
            _randint(s + 2, 20, 99).alias("popularity"),
            _uniform(s + 3, 0.0, 1.0).alias("danceability"),
            _uniform(s + 4, 0.0, 1.0).alias("energy"),
            _uniform(s + 5, -10.0, 0.0).alias("loudness"),
            _uniform(s + 6, 60.0, 200.0).alias("tempo"),
            _choice(s + 7, SMALL_GENRES).alias("genre"))
    return base.select(
        F.concat(F.lit("Artist_"), _randint(s + 1, 1, FULL_ARTISTS).cast("string")).alias("artist"),
        F.concat(F.lit("Song_"), _randint(s + 2, 1, FULL_SONGS).cast("string")).alias("song"),
        _randint(s + 3, 120000, 360000).alias("duration_ms"),
        (F.rand(s + 4) < 0.5).alias("explicit"),
        _randint(s + 5, 1990, 2024).alias("year"),
        _randint(s + 6, 0, 100).alias("popularity"),
        _uniform(s + 7, 0.0, 1.0, 3).alias("danceability"),
        _uniform(s + 8, 0.0, 1.0, 3).alias("energy"),
        _randint(s + 9, 0, 11).alias("key"),
        _uniform(s + 10, -60.0, 0.0, 3).alias("loudness"),
        _randint(s + 11, 0, 1).alias("mode"),
        _uniform(s + 12, 0.0, 1.0, 3).alias("speechiness"),
        _uniform(s + 13, 0.0, 1.0, 3).alias("acousticness"),
        _uniform(s + 14, 0.0, 1.0, 3).alias("instrumentalness"),
        _uniform(s + 15, 0.0, 1.0, 3).alias("liveness"),
        _uniform(s + 16, 0.0, 1.0, 3).alias("valence"),
        _uniform(s + 17, 60.0, 200.0, 3).alias("tempo"),
        _choice(s + 18, FULL_GENRES).alias("genre"),
        F.concat(F.lit("music_data_"), (F.col("id") % files + 1).cast("string"),
                 F.lit(".csv")).alias("file_name"))


def split_samples(df: DataFrame, n: int, id_cols: list[str], seed: int = 0,
                  exact: bool = False) -> DataFrame:
    """``n`` independent random samples of about 1/n of the rows each
    (they may overlap), tagged with ``part`` = 1..n.

    A row's draw for a sample is a hash of the sample, the seed and its
    ``id_cols``, so the samples do not depend on how the rows are laid out.
    One scan: every row is emitted once per sample that draws it.

    ``exact=True`` keeps exactly ceil(N/n) rows per sample, those ranked
    first by their draw (ties by ``id_cols``, which must identify a row).
    Ranks come from the distributed row positions, never from a one-task
    sort."""
    def draw(i):
        text = F.concat_ws(":", F.lit(str(seed + i)), *(F.col(c).cast("string") for c in id_cols))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    if not exact:
        limit = math.ceil(2**32 / n)
        wins = F.array_compact(F.array(*[F.when(draw(i) < limit, F.lit(i + 1)) for i in range(n)]))
        return df.withColumn("part", F.explode(wins))
    from cadenza.operators.ordinal import ordinal
    keep = math.ceil(df.count() / n)
    keys = F.array(*[F.struct(F.lit(i + 1).alias("part"), draw(i).alias("r")) for i in range(n)])
    drawn = df.withColumn("_d", F.explode(keys)).select("*", "_d.part", "_d.r").drop("_d")
    ranked = ordinal(drawn, ["part"], ["r", *id_cols], name="_rank")
    return ranked.filter(F.col("_rank") <= keep).drop("r", "_rank")
