"""Merge plans on ``lineitem`` (key = l_orderkey, l_linenumber; 14k repeats
at sf0.01) and the file ledger on ``orders``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators import merge as M
from cadenza.plans.registry import plan
from cadenza.session import scratch_path
from cadenza.sources import keyed_table
from cadenza.sources.files import fingerprint
from cadenza.tables import table

KEY = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
COLS = KEY + ORDER
CUT = dt.datetime(1998, 1, 1)

_ORDER_SQL = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_ORDER_DESC_SQL = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(*COLS)


@plan("dedupe_first", f"""
SELECT {', '.join(COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER_SQL}) AS rn FROM lineitem)
WHERE rn = 1""")
def dedupe_first(spark, sf):
    return M.dedupe_first(_li(spark, sf), KEY, ORDER)


@plan("duplicate_report", """
SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_unique,
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_removed
FROM lineitem GROUP BY l_returnflag""")
def duplicate_report(spark, sf):
    li = table(spark, sf, "lineitem").select(*KEY, "l_returnflag")
    return M.duplicate_report(li, KEY, ["l_returnflag"])


@plan("upsert_latest", f"""
SELECT {', '.join(COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER_DESC_SQL}) AS rn FROM lineitem)
WHERE rn = 1""")
def upsert_latest(spark, sf):
    li = _li(spark, sf)
    target = li.filter(F.col("l_shipdate") < F.lit(CUT))
    updates = li.filter(F.col("l_shipdate") >= F.lit(CUT))
    return M.upsert_latest(target, updates, KEY, ORDER)


@plan("upsert_merge", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1998-01-01'
                                        ORDER BY {_ORDER_SQL}) AS rn FROM lineitem),
t AS (SELECT * FROM b WHERE rn = 1 AND l_shipdate < TIMESTAMP '1998-01-01'),
u AS (SELECT * FROM b WHERE rn = 1 AND l_shipdate >= TIMESTAMP '1998-01-01')
SELECT coalesce(t.l_orderkey, u.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, u.l_linenumber) AS l_linenumber,
       coalesce(t.l_shipdate, u.l_shipdate) AS created_on,
       CASE WHEN u.l_shipdate IS NOT NULL THEN u.l_quantity ELSE t.l_quantity END AS l_quantity,
       CASE WHEN u.l_shipdate IS NOT NULL THEN u.l_extendedprice ELSE t.l_extendedprice END AS l_extendedprice,
       CASE WHEN u.l_shipdate IS NOT NULL THEN u.l_shipdate ELSE t.l_shipdate END AS updated_on,
       CASE WHEN t.l_shipdate IS NULL THEN 'insert' WHEN u.l_shipdate IS NOT NULL THEN 'update' ELSE 'keep' END AS action
FROM t FULL OUTER JOIN u ON t.l_orderkey = u.l_orderkey AND t.l_linenumber = u.l_linenumber""")
def upsert_merge(spark, sf):
    li = _li(spark, sf)

    def side(df):
        d = M.dedupe_first(df, KEY, ORDER)
        return d.select(*KEY, F.col("l_shipdate").alias("created_on"), "l_quantity",
                        "l_extendedprice", F.col("l_shipdate").alias("updated_on"))
    target = side(li.filter(F.col("l_shipdate") < F.lit(CUT)))
    updates = side(li.filter(F.col("l_shipdate") >= F.lit(CUT)))
    return M.upsert_merge(target, updates, KEY, ["created_on"],
                          ["l_quantity", "l_extendedprice"], "updated_on")


_FILE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
               "l_quantity", "l_extendedprice"]


@plan("upsert_batched", f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(_FILE_ORDER)}) AS rn FROM lineitem),
b AS (SELECT *, floor((rn - 1) / 100) AS batch FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_returnflag DESC, batch DESC, rn ASC) AS pick FROM b)
SELECT l_orderkey, l_linenumber, l_returnflag, rn AS row_in_file, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_shipdate
FROM w WHERE pick = 1""")
def upsert_batched(spark, sf):
    li = table(spark, sf, "lineitem").select(*COLS, "l_returnflag")
    return M.upsert_batched(li, KEY, "l_returnflag", [c for c in _FILE_ORDER if c != "l_returnflag"],
                            batch_size=100)


@plan("upsert_batched_nulls", f"""
WITH f AS (SELECT *, nullif(l_returnflag, 'N') AS file FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {', '.join(_FILE_ORDER)}) AS rn FROM f),
b AS (SELECT *, floor((rn - 1) / 100) AS batch FROM n),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY file DESC NULLS LAST, batch DESC, rn ASC) AS pick FROM b)
SELECT l_orderkey, l_linenumber, file, rn AS row_in_file, l_partkey, l_suppkey,
       l_quantity, l_extendedprice, l_shipdate
FROM w WHERE pick = 1""")
def upsert_batched_nulls(spark, sf):
    li = table(spark, sf, "lineitem").select(*COLS, F.nullif(F.col("l_returnflag"), F.lit("N")).alias("file"))
    return M.upsert_batched(li, KEY, "file", _FILE_ORDER, batch_size=100)


@plan("upsert_sink", f"""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1998-01-01'
                                        ORDER BY {_ORDER_SQL}) AS rn FROM lineitem),
t AS (SELECT * FROM b WHERE rn = 1 AND l_shipdate < TIMESTAMP '1998-01-01'),
u AS (SELECT * FROM b WHERE rn = 1 AND l_shipdate >= TIMESTAMP '1998-01-01')
SELECT coalesce(t.l_orderkey, u.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, u.l_linenumber) AS l_linenumber,
       coalesce(t.l_shipdate, u.l_shipdate) AS created_on, coalesce(u.l_quantity, t.l_quantity) AS l_quantity,
       coalesce(u.l_extendedprice, t.l_extendedprice) AS l_extendedprice,
       coalesce(u.l_shipdate, t.l_shipdate) AS updated_on
FROM t FULL OUTER JOIN u ON t.l_orderkey = u.l_orderkey AND t.l_linenumber = u.l_linenumber""")
def upsert_sink(spark, sf):
    """Two commits to a keyed table, read back."""
    path = scratch_path(spark)
    for part in (F.col("l_shipdate") < F.lit(CUT), F.col("l_shipdate") >= F.lit(CUT)):
        rows = M.dedupe_first(_li(spark, sf).filter(part), KEY, ORDER)
        keyed_table.upsert(spark, rows.select(*KEY, F.col("l_shipdate").alias("created_on"), "l_quantity",
                                              "l_extendedprice", F.col("l_shipdate").alias("updated_on")),
                           path, KEY, identity=["created_on"], buckets=8)
    return keyed_table.read_table(spark, path)


# --- file ledger: customers' orders stand for files and their versions -----
_FP_SQL = "CAST(round(o_totalprice * 100) AS BIGINT) || '_' || epoch_us(o_orderdate)"


@plan("new_files", f"""
WITH cur AS (SELECT 'file_' || o_custkey AS filename,
                    arg_max({_FP_SQL}, (o_orderdate, o_orderkey)) AS fingerprint
             FROM orders GROUP BY o_custkey),
led AS (SELECT 'file_' || o_custkey AS filename,
               arg_max({_FP_SQL}, (o_orderdate, o_orderkey)) AS fingerprint
        FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY o_custkey)
SELECT cur.filename, cur.fingerprint FROM cur
WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.filename = cur.filename AND led.fingerprint = cur.fingerprint)""")
def new_files(spark, sf):
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("file_"), F.col("o_custkey").cast("string")).alias("filename"),
        fingerprint(F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderdate")).alias("fingerprint"),
        F.col("o_orderdate").alias("processed_at"), "o_orderkey")
    # the listing shows each file's newest version
    current = M.latest_ledger(o, "filename", ["processed_at", "o_orderkey"]).select("filename", "fingerprint")
    ledger = o.filter(F.col("processed_at") < F.lit(dt.datetime(2000, 1, 1)))
    return M.new_files(current, ledger, order=["processed_at", "o_orderkey"])


@plan("ledger_append", """
SELECT 'file_' || l_suppkey AS filename,
       count(*) FILTER (WHERE l_quantity = 50 AND l_discount = 0.1) AS successful_records
FROM lineitem GROUP BY l_suppkey
HAVING count(*) FILTER (WHERE l_quantity = 50 AND l_discount = 0.1) > 0""")
def ledger_append(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("file_"), F.col("l_suppkey").cast("string")).alias("file"),
        ((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1)).alias("stored"))
    return M.ledger_entries(li, "file", "stored").select("filename", "successful_records")
