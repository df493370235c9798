"""Scoring plans on ``lineitem`` (quantity, discount, tax -> price)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import scoring as SC
from cadenza.plans.registry import plan
from cadenza.tables import table

COEF = {"l_quantity": 1200.5, "l_discount": -3000.0, "l_tax": 500.25}
INTERCEPT = 10.0
FLAG = ("l_returnflag", {"A": 5.0, "N": 0.0, "R": -5.0})


def _scored(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("predicted", SC.linear_score(COEF, INTERCEPT, FLAG))


@plan("score_linear", """
SELECT l_orderkey, l_linenumber, l_partkey,
       round(10.0 + 1200.5 * l_quantity + -3000.0 * l_discount + 500.25 * l_tax
             + CASE l_returnflag WHEN 'R' THEN -5.0 WHEN 'N' THEN 0.0 WHEN 'A' THEN 5.0 ELSE 0.0 END, 6) AS predicted
FROM lineitem""")
def score_linear(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey",
                                     F.round("predicted", 6).alias("predicted"))


@plan("train_regression", """
SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n_rows
FROM lineitem GROUP BY l_returnflag""")
def train_regression(spark, sf):
    r = SC.regression_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return r.select("l_returnflag", F.round("slope", 4).alias("slope"),
                    F.round("intercept", 4).alias("intercept"), "n_rows")


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
          "l_extendedprice"]


@plan("batch_payload", f"""
WITH s AS (SELECT *, floor((10.0 + 1200.5 * l_quantity + -3000.0 * l_discount + 500.25 * l_tax
             + CASE l_returnflag WHEN 'R' THEN -5.0 WHEN 'N' THEN 0.0 WHEN 'A' THEN 5.0 ELSE 0.0 END) * 100 + 0.5) / 100
             AS predicted
           FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(_ORDER)}) AS rn FROM s)
SELECT l_returnflag, CAST(floor((rn - 1) / 100) AS BIGINT) AS batch_no, count(*) AS n_rows,
       round(avg(predicted), 6) AS mean_score,
       CAST(to_json(list(predicted ORDER BY rn)) AS VARCHAR) AS predictions_json,
       CAST(to_json(list(l_orderkey ORDER BY rn)) AS VARCHAR) AS songs_json
FROM n GROUP BY l_returnflag, floor((rn - 1) / 100)""")
def batch_payload(spark, sf):
    # cents rounded half up with plain IEEE arithmetic (same in every engine)
    s = _scored(spark, sf).withColumn("predicted", F.floor(F.col("predicted") * 100 + 0.5) / 100)
    b = SC.batch_result(s, "l_returnflag", _ORDER, "l_orderkey", "predicted", batch_size=100)
    return b.select("l_returnflag", F.col("batch_no").cast("long").alias("batch_no"), "n_rows",
                    F.round("mean_score", 6).alias("mean_score"),
                    F.to_json("payload.predictions").alias("predictions_json"),
                    F.to_json("payload.songs").alias("songs_json"))


_LIN_SQL = """10.0 + 1200.5 * l_quantity + -3000.0 * l_discount + 500.25 * l_tax
             + CASE l_returnflag WHEN 'R' THEN -5.0 WHEN 'N' THEN 0.0 WHEN 'A' THEN 5.0 ELSE 0.0 END"""


@plan("batch_summary", f"""
SELECT l_returnflag, count(*) AS n_rows, round(avg({_LIN_SQL}), 4) AS mean_score
FROM lineitem GROUP BY l_returnflag""")
def batch_summary(spark, sf):
    return SC.batch_summary(_scored(spark, sf), "l_returnflag", "predicted").withColumn("mean_score", F.round("mean_score", 4))


@plan("batch_rows", f"""
SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(_ORDER)}, l_discount, l_tax) AS position,
       l_orderkey, l_quantity, l_discount, l_tax, round({_LIN_SQL}, 6) AS predicted
FROM lineitem""")
def batch_rows(spark, sf):
    s = _scored(spark, sf).withColumn("predicted", F.round("predicted", 6))
    return SC.batch_rows(s, "l_returnflag", [*_ORDER, "l_discount", "l_tax"], "l_orderkey",
                         ["l_quantity", "l_discount", "l_tax"], "predicted")


_RAW_TEXT_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, l_tax,
    CASE WHEN l_linenumber = 3 THEN 'x' || CAST(l_suppkey AS VARCHAR) WHEN l_linenumber = 5 THEN NULL
         ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS l_quantity FROM lineitem"""


@plan("score_rows", f"""
WITH raw AS ({_RAW_TEXT_SQL}),
t AS (SELECT * REPLACE (TRY_CAST(l_quantity AS DOUBLE) AS l_quantity) FROM raw)
SELECT l_orderkey, l_linenumber, l_quantity IS NOT NULL AS scored,
       CASE WHEN l_quantity IS NOT NULL THEN round({_LIN_SQL}, 6) END AS predicted FROM t""")
def score_rows(spark, sf):
    """Rows that do not cast are skipped, the others scored."""
    q = (F.when(F.col("l_linenumber") == 3, F.concat(F.lit("x"), F.col("l_suppkey").cast("string")))
         .when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_quantity").cast("int").cast("string")))
    raw = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_tax",
                                              q.alias("l_quantity"))
    kept, skipped = SC.score_rows(raw, SC.linear_score(COEF, INTERCEPT, FLAG), {"l_quantity": "double"})
    key = ["l_orderkey", "l_linenumber"]
    return (kept.select(*key, F.lit(True).alias("scored"), F.round("predicted", 6).alias("predicted"))
            .unionByName(skipped.select(*key, F.lit(False).alias("scored"), F.lit(None).cast("double").alias("predicted"))))


# least squares with one indicator per flag is least squares on deviations
# from the flag's means; the 3 x 3 normal equations are solved by Cramer's rule
@plan("train_fixed_effects", """
WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS mq, avg(l_discount) AS md, avg(l_tax) AS mt,
                  avg(l_extendedprice) AS my FROM lineitem GROUP BY l_returnflag),
d AS (SELECT l_quantity - mq AS q, l_discount - md AS d, l_tax - mt AS t, l_extendedprice - my AS y
      FROM lineitem JOIN m ON l_returnflag = f),
s AS (SELECT sum(q * q) AS qq, sum(q * d) AS qd, sum(q * t) AS qt, sum(d * d) AS dd, sum(d * t) AS dt, sum(t * t) AS tt,
             sum(q * y) AS qy, sum(d * y) AS dy, sum(t * y) AS ty FROM d),
w AS (SELECT (qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt)) AS det,
             (qy * (dd * tt - dt * dt) - qd * (dy * tt - dt * ty) + qt * (dy * dt - dd * ty)) AS dq,
             (qq * (dy * tt - dt * ty) - qy * (qd * tt - dt * qt) + qt * (qd * ty - dy * qt)) AS ddi,
             (qq * (dd * ty - dy * dt) - qd * (qd * ty - dy * qt) + qy * (qd * dt - dd * qt)) AS dta FROM s)
SELECT l_orderkey, l_linenumber,
       round(my + dq / det * (l_quantity - mq) + ddi / det * (l_discount - md) + dta / det * (l_tax - mt), 2) AS predicted
FROM lineitem JOIN m ON l_returnflag = f, w""")
def train_fixed_effects(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                             "l_tax", "l_returnflag", "l_extendedprice")
    model = SC.train_fixed_effects(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "l_returnflag")
    return (SC.score_fixed_effects(li, model, "l_returnflag")
            .select("l_orderkey", "l_linenumber", F.round("predicted", 2).alias("predicted")))


@plan("train_score_ml")
def train_score_ml(spark, sf):
    """Spark ML pipeline (one-hot flag + numeric features -> linear
    regression) fitted and applied on the whole table; its iterative solver
    meets the exact fit of ``train_fixed_effects`` to about 1e-3."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                             "l_tax", "l_returnflag", "l_extendedprice")
    model = SC.train(li, ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "l_extendedprice",
                     categorical=["l_returnflag"])
    return SC.score(li, model).select("l_orderkey", "l_linenumber", "predicted")
