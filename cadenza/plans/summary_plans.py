"""Summaries that merge: distributions and drift, frequent offenders, totals
kept up to date, new keys, and the text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import distributions as D
from cadenza.operators import frequent as FR
from cadenza.operators import novelty as N
from cadenza.operators import running as R
from cadenza.operators import text_index as TI
from cadenza.plans.quality_plans import FILE, LINEITEM_SUITE, lineitem_rows
from cadenza.plans.registry import plan
from cadenza.session import scratch_path, scratch_table
from cadenza.tables import table

SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]


def _stored_sketches(spark, sf):
    """A sketch per source and day of all events, as stored."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return scratch_table(D.sketches(e, ["event_type", "day"], ["value"]))


@plan("distribution_sketch", " UNION ALL ".join(f"""
SELECT event_type, CAST({s} AS DOUBLE) AS share, count(value) AS n_rows, quantile_disc(value, {s}) AS exact, TRUE AS within
FROM events GROUP BY event_type""" for s in SHARES))
def distribution_sketch(spark, sf):
    """Quantiles of merged daily sketches: whether each lies within the
    sketch's stated error of the exact one."""
    e = table(spark, sf, "events").select("event_type", "value")
    asked = D.quantiles(D.merge(_stored_sketches(spark, sf), ["event_type"]), SHARES) \
        .select(F.col("event_type").alias("t"), "share", "quantile", "n_rows")
    # one row per source and share
    places = e.join(F.broadcast(asked), F.col("event_type").eqNullSafe(F.col("t"))) \
        .groupBy("event_type", "share", "n_rows").agg(
            F.count_if(F.col("value") < F.col("quantile")).alias("below"),
            F.count_if(F.col("value") <= F.col("quantile")).alias("upto"))
    exact = D.exact_quantiles(e, ["event_type"], ["value"], SHARES).select(
        F.col("event_type").alias("t"), F.col("share").alias("s"), F.col("quantile").alias("exact"))
    error = F.lit(D.rank_error()) * F.col("n_rows") + 1
    place = F.col("share") * F.col("n_rows")
    on = F.col("event_type").eqNullSafe(F.col("t")) & (F.col("share") == F.col("s"))
    return places.join(exact, on).select(
        "event_type", "share", "n_rows", "exact",
        ((place >= F.col("below") - error) & (place <= F.col("upto") + error)).alias("within"))


_SPLIT = "2024-01-16"


@plan("distribution_drift", f"""
WITH train AS (SELECT value FROM events WHERE ts < TIMESTAMP '{_SPLIT}' AND value IS NOT NULL),
  edge AS (SELECT list_sort(list_distinct(quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges
    FROM train),
  base AS (SELECT len([x for x in edges if x < value]) AS bin, count(*) AS n FROM train, edge GROUP BY 1),
  late AS (SELECT event_type, len([x for x in edges if x < value]) AS bin, count(*) AS n FROM events, edge
    WHERE ts >= TIMESTAMP '{_SPLIT}' AND value IS NOT NULL GROUP BY 1, 2),
  grid AS (SELECT g.event_type, g.n_rows, b.bin, coalesce(l.n, 0) / g.n_rows AS p,
      coalesce(t.n, 0) / (SELECT sum(n) FROM base) AS q
    FROM (SELECT event_type, sum(n) AS n_rows FROM late GROUP BY 1) g
    CROSS JOIN (SELECT unnest(range(len(edges) + 1)) AS bin FROM edge) b
    LEFT JOIN late l ON l.event_type IS NOT DISTINCT FROM g.event_type AND l.bin = b.bin
    LEFT JOIN base t ON t.bin = b.bin),
  summed AS (SELECT *, sum(p - q) OVER (PARTITION BY event_type ORDER BY bin) AS d,
      greatest(p, {D.LEAST_SHARE}) AS p1, greatest(q, {D.LEAST_SHARE}) AS q1 FROM grid)
SELECT event_type, CAST(n_rows AS BIGINT) AS n_rows, round(sum((p1 - q1) * ln(p1 / q1)), 6) AS psi,
  round(max(abs(d)), 6) AS distance, TRUE AS sketch_near
FROM summed GROUP BY event_type, n_rows""")
def distribution_drift(spark, sf):
    """Drift of each source's later values from the earlier ones of all, on
    exact bins, and whether the stored sketches see the same distance."""
    e = table(spark, sf, "events")
    early = e.filter(F.col("ts") < F.lit(_SPLIT).cast("timestamp"))
    late = e.filter(F.col("ts") >= F.lit(_SPLIT).cast("timestamp"))
    edges = scratch_table(D.training_edges(early, ["value"]))
    base = scratch_table(D.bin_counts(early, [], ["value"], edges))
    exact = D.drift(D.bin_counts(late, ["event_type"], ["value"], edges), base, ["event_type"], edges)
    merged = D.merge(_stored_sketches(spark, sf).filter(F.col("day") >= F.lit(_SPLIT).cast("date")), ["event_type"])
    near = D.drift(D.sketch_counts(merged, ["event_type"], edges), base, ["event_type"], edges) \
        .select(F.col("event_type").alias("t"), F.col("distance").alias("sketched"))
    return exact.join(near, F.col("event_type").eqNullSafe(F.col("t"))).select(
        "event_type", "n_rows", F.round("psi", 6).alias("psi"), F.round("distance", 6).alias("distance"),
        (F.abs(F.col("distance") - F.col("sketched")) <= D.rank_error() + 1 / F.col("n_rows")).alias("sketch_near"))


_OFFENDING = [("not_null(l_discount_n)", "CAST(NULL AS VARCHAR)", "nullif(l_discount, 0.0) IS NULL"),
              ("between(l_quantity)", "CAST(l_quantity AS VARCHAR)",
               "l_quantity IS NOT NULL AND NOT isnan(l_quantity) AND NOT (l_quantity BETWEEN 5 AND 40)"),
              ("between(l_tax)", "CAST(l_tax AS VARCHAR)",
               "l_tax IS NOT NULL AND NOT isnan(l_tax) AND NOT (l_tax BETWEEN 0.0 AND 0.06)"),
              ("not_match(l_orderkey)", "CAST(l_orderkey AS VARCHAR)",
               "l_orderkey IS NOT NULL AND regexp_matches(CAST(l_orderkey AS VARCHAR), '7$')")]


@plan("dq_frequent_values", "WITH o AS (" + " UNION ALL ".join(
    f"SELECT {FILE}, '{name}' AS expectation, {value} AS value FROM lineitem WHERE {broken}"
    for name, value, broken in _OFFENDING) + f"""),
c AS (SELECT {FILE}, expectation, value, count(*) AS n_rows FROM o GROUP BY ALL)
SELECT {FILE}, expectation, row_number() OVER (PARTITION BY {FILE}, expectation
  ORDER BY n_rows DESC, value ASC NULLS LAST) AS rank, value, n_rows FROM c QUALIFY rank <= 10""")
def dq_frequent_values(spark, sf):
    """The ten most frequent offending values of every file and rule."""
    return FR.frequent_values(lineitem_rows(spark, sf), LINEITEM_SUITE, FILE, 10)


@plan("summary_kept", """
SELECT l_linenumber, count(*) AS n_rows, count(l_quantity) AS n_values, sum(l_quantity) AS total,
  min(l_quantity) AS least, max(l_quantity) AS greatest, round(avg(l_quantity), 6) AS mean
FROM lineitem GROUP BY l_linenumber""")
def summary_kept(spark, sf):
    """Three arrivals and a changed file (flag N first holds a part of its
    rows): totals from the kept states, each file read when it comes."""
    rows, folder = table(spark, sf, "lineitem"), scratch_path(spark)
    early = F.col("l_linenumber") <= 3
    arrivals = [(["A"], "1", F.lit(True)), (["N"], "1", early), (["R"], "1", F.lit(True)), (["N"], "2", F.lit(True))]
    for version, (names, fingerprint, kept) in enumerate(arrivals):
        listing = spark.createDataFrame([(n, fingerprint) for n in names], "filename string, fingerprint string")
        R.take(spark, folder, R.pending(spark, folder, listing), rows.filter(F.col(FILE).isin(names) & kept), FILE,
               ["l_linenumber"], "l_quantity", version)
    return R.summary(spark, folder, ["l_linenumber"]).withColumn("mean", F.round("mean", 6))


_PAIR = ["l_partkey", "l_suppkey"]


@plan("new_keys", f"""
WITH h AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'),
  f AS (SELECT DISTINCT {FILE}, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01')
SELECT f.{FILE}, count(*) FILTER (WHERE h.l_partkey IS NULL) AS n_new, TRUE AS within
FROM f LEFT JOIN h ON f.l_partkey = h.l_partkey AND f.l_suppkey = h.l_suppkey GROUP BY f.{FILE}""")
def new_keys(spark, sf):
    """New keys of each arriving file by joining the history, and whether
    the sketches' estimate stays within its bound."""
    li = table(spark, sf, "lineitem")
    old = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp")
    stored = N.history_sketch(N.key_sketches(li.filter(old), _PAIR, [FILE]))
    told = N.new_keys(N.key_sketches(li.filter(~old), _PAIR, [FILE]), stored, [FILE])
    seen = li.filter(old).select(*_PAIR).distinct().withColumn("old", F.lit(True))
    exact = li.filter(~old).select(FILE, *_PAIR).distinct().join(seen, _PAIR, "left") \
        .groupBy(FILE).agg(F.count_if(F.col("old").isNull()).alias("exact"))
    return told.join(exact, FILE).select(
        FILE, F.col("exact").alias("n_new"), (F.abs(F.col("n_new") - F.col("exact")) <= F.col("bound")).alias("within"))


NEEDLES = ["Ring", "ed wi", "bolt", "al", "k", "nothing like it", "small%ring"]


@plan("name_search", f"""
SELECT needle, p_partkey, p_name FROM part, (VALUES {", ".join(f"('{n}')" for n in NEEDLES)}) AS n(needle)
WHERE contains(lower(p_name), lower(needle))""")
def name_search(spark, sf):
    """Names that contain a needle, through the posting table."""
    items = table(spark, sf, "part").select("p_partkey", "p_name")
    path = scratch_path(spark)
    TI.save_postings(items, "p_partkey", "p_name", path)
    return TI.search(items, "p_partkey", "p_name", TI.open_postings(spark, path), NEEDLES)
