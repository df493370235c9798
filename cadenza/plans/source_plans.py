"""Scan, copy, append, recency and sampling plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import history as H
from cadenza.plans.registry import plan
from cadenza.session import scratch_path
from cadenza.sources import files as FS
from cadenza.sources import sinks as SK
from cadenza.sources import synth as SY
from cadenza.tables import table


@plan("table_dump", "SELECT * FROM orders")
def table_dump(spark, sf):
    return table(spark, sf, "orders")


@plan("copy_count", "SELECT count(*) AS n_rows FROM customer")
def copy_count(spark, sf):
    # the row count is observed while the rows stream to the copy
    n = SK.copy_with_count(table(spark, sf, "customer"), scratch_path(spark))
    return spark.createDataFrame([(n,)], "n_rows long")


@plan("recent_rows", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY""")
def recent_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    newest = o.agg(F.max("o_orderdate")).scalar()
    return FS.recent(o, "o_orderdate", dt.timedelta(days=1), now=newest)


_KIND_SQL = "CASE WHEN event_type IN ('click', 'view') THEN 'single' ELSE 'similar' END"


def _stored_history(spark, sf) -> str:
    """Write all events to the history of their kind, source by source; the
    kinds differ in their columns. Returns the folder."""
    e = table(spark, sf, "events")
    single = F.col("event_type").isin("click", "view")
    path = scratch_path(spark)
    web = F.col("event_type").isin("click", "purchase")
    for ours, name in ((web, "WEBAPP"), (~web, "SCHEDULED")):
        source = F.lit(name).alias("source")
        SK.append_history(e.filter(single & ours).select("event_id", "ts", "value", source), path, "single", "ts")
        SK.append_history(e.filter(~single & ours).select("event_id", "ts", "props", source), path, "similar", "ts")
    return path


@plan("history_append", f"""
SELECT event_id, ts, {_KIND_SQL} AS kind, CASE WHEN {_KIND_SQL} = 'single' THEN value END AS value,
       CASE WHEN {_KIND_SQL} = 'similar' THEN props END AS props,
       CASE WHEN event_type IN ('click', 'purchase') THEN 'WEBAPP' ELSE 'SCHEDULED' END AS source
FROM events""")
def history_append(spark, sf):
    path = _stored_history(spark, sf)
    kinds = [SK.read_history(spark, path, k).withColumn("kind", F.lit(k)).drop("day") for k in ("single", "similar")]
    return kinds[0].unionByName(kinds[1], allowMissingColumns=True)


@plan("history_kind", """
SELECT event_id, ts, value FROM events WHERE event_type IN ('click', 'view')
  AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-11 00:00:00' AND event_type = 'click'""")
def history_kind(spark, sf):
    stored = SK.read_history(spark, _stored_history(spark, sf), "single")
    return H.history(stored, "ts", "2024-01-05", "2024-01-10", source="WEBAPP", columns=["event_id", "ts", "value"])


@plan("history_filter_first", """
SELECT event_id, ts, event_type, value FROM events
WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-21 00:00:00'
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def history_filter_first(spark, sf):
    return H.history(table(spark, sf, "events"), "ts", "2024-01-05", "2024-01-20", source="purchase",
                     source_col="event_type", columns=["event_id", "ts", "event_type", "value"], latest_n=100,
                     tiebreak=["event_id"])


@plan("split_samples", " UNION ALL ".join(f"""
SELECT p_partkey, p_name, {i + 1} AS part FROM part
WHERE CAST('0x' || substr(md5('{7 + i}:' || p_partkey), 1, 8) AS BIGINT) < 1073741824""" for i in range(4)))
def split_samples(spark, sf):
    """Four independent samples of about a quarter of ``part`` each."""
    return SY.split_samples(table(spark, sf, "part").select("p_partkey", "p_name"), 4, ["p_partkey"], seed=7)
