"""Quality plans over ``lineitem`` (file = l_returnflag), ``part`` and
``orders``/``customer``; each is paired with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import quality as q
from cadenza.operators.quality import Expectation as E
from cadenza.plans.registry import plan
from cadenza.schema import ALERT_TITLE
from cadenza.tables import table

FILE = "l_returnflag"

# The lineitem suite: a null rule on discount (zero read as missing), two
# range rules, a format rule and a type rule.
LINEITEM_SUITE = [
    E("not_null", "l_discount_n"),
    E("between", "l_quantity", (5, 40)),
    E("between", "l_tax", (0.0, 0.06)),
    E("not_match", "l_orderkey", ("7$",)),
    E("of_type", "l_linenumber", ("int",)),
]


def lineitem_checked(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("l_discount_n", F.expr("nullif(l_discount, 0.0)"))
    return q.evaluate(li, LINEITEM_SUITE)


def lineitem_rows(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_discount_n", F.expr("nullif(l_discount, 0.0)"))


def lineitem_stats(spark, sf):
    return q.file_stats(lineitem_rows(spark, sf), LINEITEM_SUITE, FILE)


_PASS_SQL = """
  (nullif(l_discount, 0.0) IS NOT NULL) AS p0,
  (l_quantity IS NULL OR isnan(l_quantity) OR l_quantity BETWEEN 5 AND 40) AS p1,
  (l_tax IS NULL OR isnan(l_tax) OR l_tax BETWEEN 0.0 AND 0.06) AS p2,
  (l_orderkey IS NULL OR NOT regexp_matches(CAST(l_orderkey AS VARCHAR), '7$')) AS p3,
  TRUE AS p4"""

_STATS_CTE = f"""
WITH e AS (SELECT *, {_PASS_SQL} FROM lineitem),
s AS (
  SELECT l_returnflag,
         count(*) AS total_rows,
         count(*) FILTER (WHERE p0 AND p1 AND p2 AND p3 AND p4) AS valid_rows,
         count(*) FILTER (WHERE NOT p0) AS f0,
         count(*) FILTER (WHERE NOT p1) AS f1,
         count(*) FILTER (WHERE NOT p2) AS f2,
         count(*) FILTER (WHERE NOT p3) AS f3,
         count(*) FILTER (WHERE NOT p4) AS f4
  FROM e GROUP BY l_returnflag),
st AS (
  SELECT *, total_rows - valid_rows AS invalid_rows,
         CAST((f0 > 0) AS BIGINT) AS missing_values,
         CAST((f4 > 0) AS BIGINT) AS invalid_types,
         CAST((f1 > 0) AS BIGINT) + CAST((f2 > 0) AS BIGINT) AS out_of_range,
         CAST((f3 > 0) AS BIGINT) AS invalid_format,
         CAST(0 AS BIGINT) AS other_errors,
         CASE WHEN total_rows > 0 THEN invalid_rows / total_rows ELSE 0.0 END AS error_ratio
  FROM s)"""

_SEVERITY_SQL = """CASE WHEN error_ratio > 0.7 THEN 'HIGH' WHEN error_ratio > 0.3 THEN 'MEDIUM' ELSE 'LOW' END"""


@plan("dq_file_stats", _STATS_CTE + """
SELECT l_returnflag, total_rows, valid_rows, invalid_rows,
       missing_values, invalid_types, out_of_range, invalid_format, other_errors
FROM st""")
def dq_file_stats(spark, sf):
    return lineitem_stats(spark, sf).select(
        FILE, "total_rows", "valid_rows", "invalid_rows", *q.ERROR_CLASSES)


@plan("dq_error_counts", _STATS_CTE + """
SELECT l_returnflag, missing_values, invalid_types, out_of_range, invalid_format, other_errors,
       CAST(to_json(map(['missing_values','invalid_types','out_of_range','invalid_format','other_errors'],
                   [missing_values, invalid_types, out_of_range, invalid_format, other_errors])) AS VARCHAR) AS error_counts_json
FROM st""")
def dq_error_counts(spark, sf):
    return q.error_counts(lineitem_stats(spark, sf), FILE)


@plan("dq_severity", _STATS_CTE + f"""
SELECT l_returnflag, total_rows, invalid_rows, error_ratio,
       {_SEVERITY_SQL} AS severity,
       CASE WHEN error_ratio > 0.7 THEN 'FF0000' WHEN error_ratio > 0.3 THEN 'FFA500' ELSE '0076D7' END AS colour
FROM st""")
def dq_severity(spark, sf):
    return q.severity(lineitem_stats(spark, sf)).select(
        FILE, "total_rows", "invalid_rows", "error_ratio", "severity", "colour")


@plan("dq_alerts", _STATS_CTE + f"""
, a AS (SELECT *, CASE WHEN total_rows > 0 THEN floor((invalid_rows * 20000 + total_rows) / (total_rows * 2)) ELSE 0 END AS bp FROM st)
SELECT l_returnflag, total_rows, invalid_rows,
       CAST(CAST(floor(bp / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(bp % 100 AS BIGINT) AS VARCHAR), 2, '0') || '%' AS error_ratio_text,
       {_SEVERITY_SQL} AS severity,
       CASE WHEN error_ratio > 0.7 THEN 'FF0000' WHEN error_ratio > 0.3 THEN 'FFA500' ELSE '0076D7' END AS colour,
       format('{ALERT_TITLE.replace('%s', '{}')}', ({_SEVERITY_SQL})) AS title
FROM a WHERE invalid_rows > 0""")
def dq_alerts(spark, sf):
    return q.alerts(lineitem_stats(spark, sf), FILE)


@plan("dq_details", _STATS_CTE + """
SELECT l_returnflag, expectation, error_class, failing_rows, failing_rows = 0 AS success FROM (
  SELECT l_returnflag, 'not_null(l_discount_n)' AS expectation, 'missing_values' AS error_class, f0 AS failing_rows FROM st
  UNION ALL SELECT l_returnflag, 'between(l_quantity)', 'out_of_range', f1 FROM st
  UNION ALL SELECT l_returnflag, 'between(l_tax)', 'out_of_range', f2 FROM st
  UNION ALL SELECT l_returnflag, 'not_match(l_orderkey)', 'invalid_format', f3 FROM st
  UNION ALL SELECT l_returnflag, 'of_type(l_linenumber)', 'invalid_types', f4 FROM st)""")
def dq_details(spark, sf):
    return q.details(lineitem_stats(spark, sf), LINEITEM_SUITE, FILE)


@plan("dq_not_null", _STATS_CTE + """
SELECT l_returnflag, f0 AS failing_rows, f0 = 0 AS success FROM st""")
def dq_not_null(spark, sf):
    return (q.details(lineitem_stats(spark, sf), LINEITEM_SUITE, FILE)
            .filter(F.col("expectation") == "not_null(l_discount_n)")
            .select(FILE, "failing_rows", "success"))


@plan("dq_between", _STATS_CTE + """
SELECT l_returnflag, 'between(l_quantity)' AS expectation, f1 AS failing_rows, f1 = 0 AS success FROM st
UNION ALL SELECT l_returnflag, 'between(l_tax)', f2, f2 = 0 FROM st""")
def dq_between(spark, sf):
    return (q.details(lineitem_stats(spark, sf), LINEITEM_SUITE, FILE)
            .filter(F.col("error_class") == "out_of_range")
            .select(FILE, "expectation", "failing_rows", "success"))


_ROW_FAILED_SQL = """concat_ws(',',
    CASE WHEN NOT p0 THEN 'not_null(l_discount_n)' END,
    CASE WHEN NOT p1 THEN 'between(l_quantity)' END,
    CASE WHEN NOT p2 THEN 'between(l_tax)' END,
    CASE WHEN NOT p3 THEN 'not_match(l_orderkey)' END,
    CASE WHEN NOT p4 THEN 'of_type(l_linenumber)' END)"""


@plan("dq_row_mask", f"""
WITH e AS (SELECT *, {_PASS_SQL} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
       (p0 AND p1 AND p2 AND p3 AND p4) AS is_valid,
       {_ROW_FAILED_SQL} AS failed_rules
FROM e""")
def dq_row_mask(spark, sf):
    # one pass: the mask and its complement are the two values of is_valid
    ev = lineitem_checked(spark, sf)
    return ev.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", FILE,
                     q.row_valid().alias("is_valid"),
                     F.array_join(q.FAILED, ",").alias("failed_rules"))


@plan("dq_route", f"""
WITH e AS (SELECT *, (p0 AND p1 AND p2 AND p3 AND p4) AS ok FROM (SELECT *, {_PASS_SQL} FROM lineitem)),
c AS (SELECT l_returnflag, count(*) AS t, count(*) FILTER (WHERE ok) AS v FROM e GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.l_returnflag,
       CASE WHEN v = t THEN 'good' WHEN v = 0 THEN 'bad' WHEN ok THEN 'good' ELSE 'bad' END AS route,
       CASE WHEN v = t OR v = 0 THEN e.l_returnflag WHEN ok THEN 'valid_' || e.l_returnflag
            ELSE 'invalid_' || e.l_returnflag END AS dest_name
FROM e JOIN c ON e.l_returnflag = c.l_returnflag""")
def dq_route(spark, sf):
    return (q.route(lineitem_rows(spark, sf), LINEITEM_SUITE, FILE)
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", FILE, "route", "dest_name"))


@plan("dq_route_nulls", f"""
WITH e AS (SELECT *, nullif(l_returnflag, 'N') AS file, (p0 AND p1 AND p2 AND p3 AND p4) AS ok
           FROM (SELECT *, {_PASS_SQL} FROM lineitem)),
c AS (SELECT file, count(*) AS t, count(*) FILTER (WHERE ok) AS v FROM e GROUP BY file)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.file,
       CASE WHEN v = t THEN 'good' WHEN v = 0 THEN 'bad' WHEN ok THEN 'good' ELSE 'bad' END AS route,
       CASE WHEN v = t OR v = 0 THEN e.file WHEN ok THEN 'valid_' || e.file
            ELSE 'invalid_' || e.file END AS dest_name
FROM e JOIN c ON e.file IS NOT DISTINCT FROM c.file""")
def dq_route_nulls(spark, sf):
    rows = lineitem_rows(spark, sf).withColumn("file", F.nullif(F.col(FILE), F.lit("N")))
    return (q.route(rows, LINEITEM_SUITE, "file")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "file", "route", "dest_name"))


# --- raw-text rules on part: type and format ------------------------------
PART_TEXT_SUITE = [
    E("of_type", "brand_text", ("int",)),
    E("of_type", "size_text", ("int",)),
    E("of_type", "p_name", ("str",)),
    E("not_match", "brand_text", ("[a-zA-Z]",)),
    E("not_match", "size_text", ("[a-zA-Z]",)),
]


def _part_text_stats(spark, sf):
    p = table(spark, sf, "part").select(
        "p_type", "p_name", F.col("p_brand").alias("brand_text"),
        F.col("p_size").cast("string").alias("size_text"))
    return q.file_stats(p, PART_TEXT_SUITE, "p_type")


_INT_TEXT = "regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$') AND TRY_CAST({c} AS BIGINT) BETWEEN -2147483648 AND 2147483647"
_PART_TEXT_CTE = f"""
WITH p AS (SELECT p_type, p_name, p_brand AS brand_text, CAST(p_size AS VARCHAR) AS size_text FROM part),
s AS (SELECT p_type,
  count(*) FILTER (WHERE NOT (brand_text IS NULL OR ({_INT_TEXT.format(c='brand_text')}))) AS f0,
  count(*) FILTER (WHERE NOT (size_text IS NULL OR ({_INT_TEXT.format(c='size_text')}))) AS f1,
  CAST(0 AS BIGINT) AS f2,
  count(*) FILTER (WHERE brand_text IS NOT NULL AND regexp_matches(brand_text, '[a-zA-Z]')) AS f3,
  count(*) FILTER (WHERE size_text IS NOT NULL AND regexp_matches(size_text, '[a-zA-Z]')) AS f4
  FROM p GROUP BY p_type)"""


@plan("dq_of_type", _PART_TEXT_CTE + """
SELECT p_type, 'of_type(brand_text)' AS expectation, f0 AS failing_rows FROM s
UNION ALL SELECT p_type, 'of_type(size_text)', f1 FROM s
UNION ALL SELECT p_type, 'of_type(p_name)', f2 FROM s""")
def dq_of_type(spark, sf):
    return (q.details(_part_text_stats(spark, sf), PART_TEXT_SUITE, "p_type")
            .filter(F.col("error_class") == "invalid_types")
            .select("p_type", "expectation", "failing_rows"))


@plan("dq_not_match", _PART_TEXT_CTE + """
SELECT p_type, 'not_match(brand_text)' AS expectation, f3 AS failing_rows FROM s
UNION ALL SELECT p_type, 'not_match(size_text)', f4 FROM s""")
def dq_not_match(spark, sf):
    return (q.details(_part_text_stats(spark, sf), PART_TEXT_SUITE, "p_type")
            .filter(F.col("error_class") == "invalid_format")
            .select("p_type", "expectation", "failing_rows"))


# --- file outcomes: every customer is a listed file, its orders the rows --
@plan("dq_file_outcome", """
WITH s AS (SELECT o_custkey, count(*) AS total_rows,
                  count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 400000) AS valid_rows
           FROM orders GROUP BY o_custkey)
SELECT 'file_' || CAST(c.c_custkey AS VARCHAR) AS file_name,
       coalesce(s.total_rows, 0) AS total_rows, coalesce(s.valid_rows, 0) AS valid_rows,
       coalesce(s.total_rows - s.valid_rows, 0) AS invalid_rows,
       CASE WHEN s.total_rows IS NULL OR s.total_rows = 0 THEN 'empty_file' ELSE 'ok' END AS outcome
FROM customer c LEFT JOIN s ON c.c_custkey = s.o_custkey""")
def dq_file_outcome(spark, sf):
    suite = [E("between", "o_totalprice", (1000, 400000))]
    name = F.concat(F.lit("file_"), F.col("o_custkey").cast("string")).alias("file_name")
    rows = table(spark, sf, "orders").select(name, "o_totalprice")
    stats = q.file_stats(rows, suite, "file_name")
    files = table(spark, sf, "customer").select(
        F.concat(F.lit("file_"), F.col("c_custkey").cast("string")).alias("file_name"))
    return q.file_outcomes(files, stats, "file_name").select(
        "file_name", "total_rows", "valid_rows", "invalid_rows", "outcome")
