"""Feature distributions as mergeable quantile sketches, and their drift.

A KLL sketch of every feature is kept per file and day. Sketches merge, so
the distribution over any files and days comes from the stored sketches
alone; no row is read again. A sketch of size k has ``k`` times a small
factor of entries, whatever the rows, and answers ranks within
``rank_error(k)`` of the exact ones (with high probability, as published
for the sketch).

Drift compares a distribution with the training distribution on bins
between the training quantiles: the population stability index
``sum((p - q) ln(p / q))`` and the largest difference of the cumulative
shares at the bin edges. Shares come exactly from rows (:func:`bin_counts`)
or approximately from sketches (:func:`sketch_counts`).

Null and NaN values have no place in a distribution and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordinal import ordinal

#: Size of a sketch.
SIZE = 400
#: A bin's share counts as at least this, so that empty bins have a logarithm.
LEAST_SHARE = 1e-4


def rank_error(size: int = SIZE) -> float:
    """Largest error of a rank, as a share of the rows, that the sketch's
    authors state for 99% of queries."""
    return 2.296 / size ** 0.9021


def _long(df: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in features)) \
        .unpivot(by, features, "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def sketches(df: DataFrame, by: list[str], features: list[str], size: int = SIZE) -> DataFrame:
    """One row per group and feature: ``n_rows, lo, hi, sketch``. The sketch
    is a partial aggregate: a file in a third of all rows is reduced in each
    task."""
    return _long(df, by, features).groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merge(stored: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of groups, merged over whatever else told them apart."""
    return stored.groupBy(*by, "feature").agg(
        F.sum("n_rows").alias("n_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(merged: DataFrame, shares: list[float]) -> DataFrame:
    """``share, quantile`` rows of every merged sketch."""
    kept = [c for c in merged.columns if c != "sketch"]
    pairs = F.array(*(F.struct(F.lit(s).alias("share"),
                               F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("quantile")) for s in shares))
    return merged.select(*kept, F.inline(pairs))


def exact_quantiles(df: DataFrame, by: list[str], features: list[str], shares: list[float]) -> DataFrame:
    """``share, quantile`` rows per group and feature, exactly: the value at
    the place of each share in the order of all values. Places come from
    :func:`ordinal`, so no task holds a group."""
    long = _long(df, by, features)
    keys = [*by, "feature"]
    sizes = long.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("_n"))
    place = [F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - F.col("_n") * F.lit(s))) for s in shares]
    wanted = sizes.select(*(f"_{k}" for k in keys), F.inline(F.array(*(
        F.struct(F.lit(s).alias("share"), p.cast("bigint").alias("_place")) for s, p in zip(shares, place)))))
    numbered = ordinal(long, keys, ["value"], name="place").withColumn("place", F.col("place").cast("bigint"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return numbered.join(wanted, [*on, F.col("place") == F.col("_place")]) \
        .select(*keys, "share", F.col("value").alias("quantile"))


def training_edges(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """``feature, edges``: the exact quantiles of the training rows between
    equal bins, each once."""
    found = exact_quantiles(df, [], features, [i / bins for i in range(1, bins)])
    # a feature has as many rows here as edges
    return found.groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))


def bin_counts(df: DataFrame, by: list[str], features: list[str], edges: DataFrame) -> DataFrame:
    """``bin, n`` per group and feature, from rows: bin i holds the values
    above i edges. ``edges`` has a row for each feature (broadcast)."""
    long = _long(df, by, features).join(F.broadcast(edges), "feature")
    above = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return long.groupBy(*by, "feature", above.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sketch_counts(merged: DataFrame, by: list[str], edges: DataFrame) -> DataFrame:
    """The same from merged sketches, as shares of the rows times their
    number. A sketch is asked for constants only, so the edges (a few for
    each feature) come to the driver."""
    cuts = {r["feature"]: r["edges"] for r in edges.collect()}
    ranks = F.array().cast("array<double>")
    for feature, at in cuts.items():
        own = F.array(*(F.kll_sketch_get_rank_double("sketch", F.lit(float(e))) for e in at)).cast("array<double>")
        ranks = F.when(F.col("feature") == feature, own).otherwise(ranks)
    rows = merged.filter(F.col("feature").isin(list(cuts))).withColumn("ranks", ranks)
    rows = rows.withColumn("parts", F.arrays_zip(
        F.concat(F.array(F.lit(0.0)), "ranks").alias("lower"), F.concat("ranks", F.array(F.lit(1.0))).alias("upper")))
    return rows.select(*by, "feature", "n_rows", F.posexplode("parts").alias("bin", "p")) \
        .select(*by, "feature", "bin", ((F.col("p.upper") - F.col("p.lower")) * F.col("n_rows")).alias("n"))


def drift(counts: DataFrame, training: DataFrame, by: list[str], edges: DataFrame) -> DataFrame:
    """Per group and feature: ``n_rows``, ``psi`` and ``distance`` of its
    bins (``bin, n``) from those of the training rows (``feature, bin, n``).
    Bins that either side lacks count."""
    bins = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    base = bins.join(training.select("feature", "bin", F.col("n").alias("t")), ["feature", "bin"], "left")
    totals = training.groupBy("feature").agg(F.sum("n").alias("t_all"))
    groups = counts.groupBy(*by, "feature").agg(F.sum("n").alias("n_rows"))
    grid = groups.join(F.broadcast(base), "feature").join(F.broadcast(totals), "feature")  # one row a feature and bin
    named = [F.col(c).alias(f"_{c}") for c in by]
    have = counts.select(*named, F.col("feature").alias("_feature"), F.col("bin").alias("_bin"), "n")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "feature", "bin"]]
    rows = grid.join(have, on, "left")
    p, q = F.coalesce("n", F.lit(0)) / F.col("n_rows"), F.coalesce("t", F.lit(0)) / F.col("t_all")
    rows = rows.select(*by, "feature", "n_rows", "bin", p.alias("p"), q.alias("q"))
    p1, q1 = F.greatest("p", F.lit(LEAST_SHARE)), F.greatest("q", F.lit(LEAST_SHARE))
    # a group has as many rows here as there are bins
    listed = F.array_sort(F.collect_list(F.struct("bin", (F.col("p") - F.col("q")).alias("d"))))
    out = rows.groupBy(*by, "feature", "n_rows").agg(F.sum((p1 - q1) * F.log(p1 / q1)).alias("psi"), listed.alias("ds"))
    step = F.aggregate("ds", F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most")),
                       lambda a, x: F.struct((a["sum"] + x["d"]).alias("sum"),
                                             F.greatest(a["most"], F.abs(a["sum"] + x["d"])).alias("most")))
    return out.select(*by, "feature", F.col("n_rows").cast("bigint").alias("n_rows"), "psi",
                      step["most"].alias("distance"))
