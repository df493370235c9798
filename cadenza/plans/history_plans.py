"""History and paging plans on ``events`` (event_type plays the source)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import columns as C
from cadenza.functions import predicates as P
from cadenza.operators import history as H
from cadenza.operators import paging as PG
from cadenza.plans.registry import plan
from cadenza.plans.source_plans import _stored_history
from cadenza.sources import sinks as SK
from cadenza.tables import table

COLS = ["event_id", "ts", "event_type", "value"]


@plan("history_next_midnight", """
SELECT event_id, ts, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-11 00:00:00' AND event_type = 'click'""")
def history_next_midnight(spark, sf):
    return H.history(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-10", "next_midnight",
                     source="click", source_col="event_type", columns=COLS)


@plan("history_midnight", """
SELECT event_id, ts, event_type, value FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def history_midnight(spark, sf):
    return H.history(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-10", "midnight",
                     source="ALL", source_col="event_type", columns=COLS)


@plan("history_by_date", """
SELECT event_id, ts, event_type, value FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' AND event_type = 'view'""")
def history_by_date(spark, sf):
    return H.history(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-10", "date",
                     source="view", source_col="event_type", columns=COLS)


@plan("history_scheduled", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_rows, round(avg(value), 6) AS mean_score FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY CAST(ts AS DATE)""")
def history_scheduled(spark, sf):
    d = H.history_by_day(table(spark, sf, "events"), "ts", "value", "2024-01-03", "2024-01-20")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_rows",
                    F.round("mean_score", 6).alias("mean_score"))


@plan("history_latest", """
SELECT event_id, ts, event_type, value FROM (
  SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)
WHERE event_type = 'purchase'""")
def history_latest(spark, sf):
    # the older front-end order: newest 100 first, then the source filter
    return H.history(table(spark, sf, "events"), "ts", source="purchase", source_col="event_type",
                     columns=COLS, latest_n=100, filter_after_limit=True, tiebreak=["event_id"])


@plan("parse_day", """
WITH t AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props ELSE strftime(ts, '%Y-%m-%d') END AS day_text
           FROM events)
SELECT event_id, day_text, try_strptime(day_text, '%Y-%m-%d') AS day FROM t""")
def parse_day(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", F.col("props"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day_text"))
    return e.withColumn("day", C.parse_day("day_text"))


@plan("page", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20""")
def page(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return P.page(p, [F.col("p_retailprice").desc(), F.col("p_partkey")], limit=10, offset=20)


@plan("page_recent", """
SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""")
def page_recent(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "event_type")
    return P.page(e, [F.col("ts").desc(), F.col("event_id").desc()], limit=100, offset=0)


@plan("page_deep", """
SELECT l_shipdate, l_extendedprice, l_orderkey, l_linenumber FROM lineitem
ORDER BY l_shipdate DESC NULLS LAST, l_extendedprice NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST
LIMIT 100 OFFSET (SELECT count(*) // 2 FROM lineitem)""")
def page_deep(spark, sf):
    """A page in the middle of the table: no task sorts the half before it."""
    rows = table(spark, sf, "lineitem").select("l_shipdate", "l_extendedprice", "l_orderkey", "l_linenumber")
    by = [PG.By("l_shipdate", True), PG.By("l_extendedprice"), PG.By("l_orderkey"), PG.By("l_linenumber")]
    return PG.deep_page(rows, by, limit=100, offset=rows.count() // 2)


@plan("history_newest", """
SELECT event_id, ts, value FROM events WHERE event_type IN ('click', 'view') AND event_type = 'click'
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def history_newest(spark, sf):
    """The newest 100 of a stored history: only its last days are read."""
    stored = SK.read_history(spark, _stored_history(spark, sf), "single")
    return PG.newest(stored, "ts", 100, ["event_id"], F.col("source") == "WEBAPP").select("event_id", "ts", "value")
