"""Projection, coercion, filter, lookup and summary plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import columns as C
from cadenza.functions import predicates as P
from cadenza.operators import lookup as L
from cadenza.operators import summary as S
from cadenza.operators.quality import profile
from cadenza.plans.registry import plan
from cadenza.tables import table


@plan("project_cols", "SELECT p_partkey, p_name, p_retailprice FROM part")
def project_cols(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")


@plan("coerce_numeric", """
SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_num,
       TRY_CAST(p_name AS DOUBLE) AS name_num, TRY_CAST(p_type AS DOUBLE) AS type_num
FROM part""")
def coerce_numeric(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey",
                    C.to_numeric(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_num"),
                    C.to_numeric("p_name").alias("name_num"),
                    C.to_numeric("p_type").alias("type_num"))


@plan("cast_or_drop", """
WITH r AS (SELECT p_partkey,
                  CASE WHEN p_size % 3 = 0 THEN p_name ELSE CAST(p_retailprice AS VARCHAR) END AS mixed_text,
                  CAST(p_retailprice AS VARCHAR) AS price_text FROM part)
SELECT p_partkey, TRY_CAST(mixed_text AS DOUBLE) AS mixed_text,
       CAST(trunc(TRY_CAST(price_text AS DOUBLE)) AS INTEGER) AS price_text
FROM r WHERE TRY_CAST(mixed_text AS DOUBLE) IS NOT NULL AND TRY_CAST(price_text AS DOUBLE) IS NOT NULL""")
def cast_or_drop(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 3 == 0, F.col("p_name"))
         .otherwise(F.col("p_retailprice").cast("string")).alias("mixed_text"),
        F.col("p_retailprice").cast("string").alias("price_text"))
    kept, _dropped = C.cast_or_drop(p, {"mixed_text": "double", "price_text": "int"})
    return kept


@plan("fill_missing", """
SELECT l_orderkey, l_linenumber, l_partkey,
       coalesce(nullif(l_discount, 0.0), 0.0) AS l_discount,
       coalesce(nullif(l_returnflag, 'N'), 'Unknown') AS l_returnflag
FROM lineitem""")
def fill_missing(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr("nullif(l_discount, 0.0)").alias("l_discount"),
        F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"))
    return C.fill(li, {"l_discount": 0.0, "l_returnflag": "Unknown"})


@plan("drop_incomplete", """
SELECT p_partkey, nullif(p_size, 1) AS p_size, nullif(p_type, 'PROMO') AS p_type FROM part
WHERE nullif(p_size, 1) IS NOT NULL AND nullif(p_type, 'PROMO') IS NOT NULL""")
def drop_incomplete(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", F.expr("nullif(p_size, 1)").alias("p_size"),
        F.expr("nullif(p_type, 'PROMO')").alias("p_type"))
    return C.drop_incomplete(p, ["p_size", "p_type"])


@plan("non_empty", """
SELECT p_partkey FROM part
WHERE (CASE WHEN p_size < 5 THEN '' ELSE p_name END) IS NOT NULL
  AND length(CASE WHEN p_size < 5 THEN '' ELSE p_name END) > 0
  AND nullif(p_type, 'SMALL') IS NOT NULL AND length(nullif(p_type, 'SMALL')) > 0""")
def non_empty(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 5, F.lit("")).otherwise(F.col("p_name")).alias("song"),
        F.expr("nullif(p_type, 'SMALL')").alias("genre"))
    return p.filter(C.non_empty("song", "genre")).select("p_partkey")


@plan("format_columns", """
SELECT event_id, value AS score, printf('%.2f', value) AS score_text,
       strftime(ts, '%Y-%m-%d %H:%M') AS ts_minute, strftime(ts, '%Y-%m-%d') AS ts_date,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso
FROM events""")
def format_columns(spark, sf):
    e = table(spark, sf, "events").withColumnsRenamed({"value": "score"})
    return e.select("event_id", "score",
                    C.two_decimals("score").alias("score_text"),
                    C.format_ts("ts", "minute").alias("ts_minute"),
                    C.format_ts("ts", "date").alias("ts_date"),
                    C.format_ts("ts", "iso").alias("ts_iso"))


@plan("template_text", """
SELECT event_id, printf('Predicted for %s with %s danceability and %s tempo',
                        event_type, CAST(value AS VARCHAR), CAST(user_id AS VARCHAR)) AS prediction
FROM events""")
def template_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", C.describe_row("event_type", "value", "user_id").alias("prediction"))


@plan("json_roundtrip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       CAST(to_json({'event_id': event_id, 'k': CAST(json_extract(props, '$.k') AS INTEGER), 'event_type': event_type}) AS VARCHAR) AS payload
FROM events""")
def json_roundtrip(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", C.from_json_col("props", "k INT")["k"].alias("k"))
    return e.select("event_id", "k", C.to_json_col("event_id", "k", "event_type").alias("payload"))


@plan("letters_only", r"""
SELECT conv_id, turn,
       coalesce(regexp_matches(text, '^[a-zA-Z ]+$'), false) AS text_ascii_ok,
       coalesce(regexp_matches(text, '^[\p{L} ]*\p{L}[\p{L} ]*$'), false) AS text_unicode_ok,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words,
       CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[a-zA-Z ]+$'))) AS INTEGER) AS ascii_words,
       CAST(len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[\p{L} ]*\p{L}[\p{L} ]*$'))) AS INTEGER) AS unicode_words
FROM conversations""")
def letters_only(spark, sf):
    # whole texts: the full text, and every word of it (a per-row array
    # filter, no explode and no shuffle)
    c = table(spark, sf, "conversations").withColumn("_w", F.split("text", " "))
    return c.select("conv_id", "turn",
                    C.letters_only("text", unicode=False).alias("text_ascii_ok"),
                    C.letters_only("text", unicode=True).alias("text_unicode_ok"),
                    F.size("_w").alias("n_words"),
                    F.size(F.filter("_w", lambda w: C.letters_only(w, unicode=False))).alias("ascii_words"),
                    F.size(F.filter("_w", lambda w: C.letters_only(w, unicode=True))).alias("unicode_words"))


@plan("contains_ci", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')""")
def contains_ci(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(P.contains_ci("p_name", "RiNg")).select("p_partkey", "p_name")


@plan("contains_ci_regex", """
SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '^[a-m].*(ring|ed)')""")
def contains_ci_regex(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(P.contains_ci("p_name", "^[A-M].*(RING|ed)", regex=True)).select("p_partkey", "p_name")


@plan("range_filter", """
SELECT p_partkey, p_size, p_retailprice FROM part
WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950 AND 1500""")
def range_filter(spark, sf):
    p = table(spark, sf, "part")
    return (p.filter(P.in_range("p_size", 10, 30) & P.in_range("p_retailprice", 950, 1500))
            .select("p_partkey", "p_size", "p_retailprice"))


@plan("category_filter", """
SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'promo')""")
def category_filter(spark, sf):
    p = table(spark, sf, "part")
    return P.category(p, "p_type", "Promo").select("p_partkey", "p_type")


@plan("source_filter", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'click'""")
def source_filter(spark, sf):
    e = table(spark, sf, "events")
    return P.source_is(e, "event_type", "click").select("event_id", "event_type", "value")


@plan("split_max", """
SELECT o_orderkey, CASE WHEN year(o_orderdate) > 1999 THEN 'above' ELSE 'kept' END AS side FROM orders""")
def split_max(spark, sf):
    # both halves of the split in one pass: each row is labelled by the
    # predicate split_max filters on
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return o.select("o_orderkey", F.when(P.above_max("year", 1999), "above")
                    .otherwise("kept").alias("side"))


# --- lookups: requests are part names of large parts plus supplier names --
def _requests(spark, sf):
    ordered = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    known = table(spark, sf, "part").join(ordered, "p_partkey", "left_semi").select(F.col("p_name").alias("request"))
    return known.unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("request")))


# requests: the names of all parts that were ordered, and unknown names
_REQ_SQL = ("(SELECT p_name AS request FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) "
            "UNION ALL SELECT s_name FROM supplier)")


@plan("name_exists", f"""
SELECT request FROM {_REQ_SQL} r WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_name = r.request)""")
def name_exists(spark, sf):
    return L.name_exists(_requests(spark, sf), table(spark, sf, "part"), "p_name")


@plan("lookup_first", f"""
WITH f AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name)
SELECT DISTINCT r.request, p.p_name, p.p_partkey, p.p_brand, p.p_type, p.p_size, p.p_retailprice
FROM {_REQ_SQL} r JOIN f ON r.request = f.p_name JOIN part p ON p.p_partkey = f.p_partkey""")
def lookup_first(spark, sf):
    return L.lookup_first(_requests(spark, sf), table(spark, sf, "part"), "p_name", "p_partkey")


@plan("lookup_or_error", f"""
WITH f AS (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name),
r AS (SELECT DISTINCT request FROM {_REQ_SQL})
SELECT r.request, f.p_name IS NOT NULL AS found, p.p_partkey, p.p_type, p.p_retailprice,
       CASE WHEN f.p_name IS NULL THEN 'Song not found' END AS error
FROM r LEFT JOIN f ON r.request = f.p_name LEFT JOIN part p ON p.p_partkey = f.p_partkey""")
def lookup_or_error(spark, sf):
    return L.lookup_or_error(_requests(spark, sf), table(spark, sf, "part"), "p_name",
                             "p_partkey", ["p_type", "p_retailprice"])


@plan("valid_category", r"""
WITH t AS (SELECT DISTINCT trim(u.token) AS token
           FROM part, unnest(regexp_split_to_array(lower(p_name), ',\s*')) AS u(token)),
r AS (SELECT DISTINCT u.w AS request FROM part, unnest(string_split(p_name, ' ')) AS u(w)
      UNION SELECT DISTINCT c_mktsegment FROM customer)
SELECT request, EXISTS (SELECT 1 FROM t WHERE t.token = lower(trim(r.request)) AND length(t.token) > 0
                        AND t.token <> 'set()') AS valid FROM r""")
def valid_category(spark, sf):
    # every word of every name is a request, plus market segments (unknown)
    req = (table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("request"))
           .unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("request"))))
    return L.valid_category(req, table(spark, sf, "part"), "p_name")


# --- summaries --------------------------------------------------------------
@plan("score_summary", """
SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean_score FROM events GROUP BY event_type""")
def score_summary(spark, sf):
    s = S.score_summary(table(spark, sf, "events"), "value", ["event_type"])
    return s.withColumn("mean_score", F.round("mean_score", 6))


@plan("mean_of_means", """
SELECT event_type, round(avg(m), 6) AS mean_of_means, count(*) AS n_batches
FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY event_type, user_id)
GROUP BY event_type""")
def mean_of_means(spark, sf):
    s = S.mean_of_means(table(spark, sf, "events"), "value", ["user_id"], ["event_type"])
    return s.withColumn("mean_of_means", F.round("mean_of_means", 6))


@plan("column_bounds", """
SELECT min(p_size) AS p_size_min, max(p_size) AS p_size_max,
       min(p_retailprice) AS p_retailprice_min, max(p_retailprice) AS p_retailprice_max FROM part""")
def column_bounds(spark, sf):
    return S.bounds(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@plan("distinct_values", """
SELECT p_type, min(p_partkey) AS first_seen FROM part WHERE p_type IS NOT NULL GROUP BY p_type""")
def distinct_values(spark, sf):
    return S.distinct_values(table(spark, sf, "part"), "p_type", first_seen_by="p_partkey")


@plan("column_profile", """
WITH l AS (SELECT 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
           UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi
      FROM l GROUP BY feature),
h AS (SELECT l.feature, CAST(CASE WHEN s.hi = s.lo THEN 0
                  ELSE least(floor((l.value - s.lo) / ((s.hi - s.lo) / 10)), 9) END AS INTEGER) AS bin,
             count(*) AS rows
      FROM l JOIN s ON l.feature = s.feature WHERE l.value IS NOT NULL GROUP BY ALL)
SELECT h.feature, h.bin, h.rows, round(s.mean, 6) AS mean, round(s.std, 6) AS std
FROM h JOIN s ON h.feature = s.feature""")
def column_profile(spark, sf):
    stats, hist = profile(table(spark, sf, "part"), ["p_size", "p_retailprice"], bins=10)
    return (hist.join(stats.select("feature", F.round("mean", 6).alias("mean"),
                                   F.round("std", 6).alias("std")), "feature"))
