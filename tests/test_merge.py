import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import merge as M
from cadenza.operators.ordinal import ordinal


def test_dedupe_first_and_upsert_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, t int, v string")
    first = {r["k"]: r["v"] for r in M.dedupe_first(df, ["k"], ["t"]).collect()}
    assert first == {"a": "x", "b": "z"}
    upd = spark.createDataFrame([("a", 3, "w"), ("c", 1, "n")], "k string, t int, v string")
    up = M.upsert_latest(df, upd, ["k"], ["t"])
    got = {r["k"]: r["v"] for r in up.collect()}
    assert got == {"a": "w", "b": "z", "c": "n"}
    # key unique after upsert, and idempotent when applied again
    assert up.count() == up.select("k").distinct().count()
    again = {r["k"]: r["v"] for r in M.upsert_latest(up, upd, ["k"], ["t"]).collect()}
    assert again == got


def test_upsert_merge_keeps_identity(spark):
    t = spark.createDataFrame([("a", 100, 1.0, 1), ("b", 200, 2.0, 1)], "k string, id int, p double, ts int")
    u = spark.createDataFrame([("a", 999, 5.0, 2), ("c", 300, 3.0, 2)], "k string, id int, p double, ts int")
    got = {r["k"]: (r["id"], r["p"], r["ts"], r["action"]) for r in M.upsert_merge(t, u, ["k"], ["id"], ["p"], "ts").collect()}
    assert got == {"a": (100, 5.0, 2, "update"), "b": (200, 2.0, 1, "keep"), "c": (300, 3.0, 2, "insert")}


def test_ordinal_matches_row_number_on_skewed_groups(spark):
    rnd = random.Random(3)
    # one hot group holds most rows
    data = [("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 9)}", i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, id int, x double")
    got = ordinal(df, ["g"], ["x", "id"], num_partitions=7)
    w = Window.partitionBy("g").orderBy("x", "id")
    ref = df.withColumn("rn_ref", F.row_number().over(w))
    j = got.join(ref.select("id", "rn_ref"), "id")
    assert j.filter(F.col("rn") != F.col("rn_ref")).count() == 0
    assert j.count() == 3000


def _loop_upsert(rows, batch_size):
    """The original row loop: per file in name order, batches of
    ``batch_size``; first wins inside a batch, later batches overwrite."""
    table = {}
    files = sorted({r[0] for r in rows})
    for f in files:
        frows = sorted([r for r in rows if r[0] == f], key=lambda r: r[2])
        for b in range(0, len(frows), batch_size):
            seen = set()
            for r in frows[b:b + batch_size]:
                if r[1] in seen:
                    continue
                seen.add(r[1])
                table[r[1]] = r
    return table


def test_upsert_batched_matches_row_loop(spark):
    rnd = random.Random(5)
    rows = [(f"file{rnd.randint(1, 3)}", rnd.randint(1, 40), i, rnd.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "f string, k int, o int, v double")
    got = {r["k"]: (r["f"], r["o"]) for r in M.upsert_batched(df, ["k"], "f", ["o"], batch_size=10).collect()}
    ref = {k: (r[0], r[2]) for k, r in _loop_upsert(rows, 10).items()}
    assert got == ref


def test_new_files_and_ledger(spark):
    cur = spark.createDataFrame([("a.csv", "1_1"), ("b.csv", "2_2"), ("c.csv", "3_3")], "filename string, fingerprint string")
    led = spark.createDataFrame([("a.csv", "1_1", 1), ("b.csv", "2_2", 1), ("b.csv", "2_0", 2)],
                                "filename string, fingerprint string, processed_at int")
    got = sorted(r["filename"] for r in M.new_files(cur, led).collect())
    assert got == ["b.csv", "c.csv"]  # b changed (last ledger entry wins), c is new
    res = spark.createDataFrame([("a.csv", True), ("a.csv", False), ("b.csv", False)], "f string, ok boolean")
    ent = {r["filename"]: r["successful_records"] for r in M.ledger_entries(res, "f", "ok").collect()}
    assert ent == {"a.csv": 1}


def test_duplicate_report(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, n int")
    r = M.duplicate_report(df, ["k", "n"]).collect()[0]
    assert (r["n_rows"], r["n_unique"], r["n_removed"]) == (3, 2, 1)


def test_hot_group_is_numbered_by_many_tasks(spark):
    # one "file" holds about two thirds of the rows, derived from a given table
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(
        F.when(F.col("l_returnflag") != "N", F.lit("hot")).otherwise(F.col("l_returnflag")).alias("f"),
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    got = ordinal(li, ["f"], order, num_partitions=8, keep_task_ids=True)
    tasks = got.filter(F.col("f") == "hot").select("task_id").distinct().count()
    assert tasks >= 4  # the hot group is spread, not funnelled into one task
    ref = li.withColumn("rn_ref", F.row_number().over(Window.partitionBy("f").orderBy(*order)))
    bad = got.join(ref, ["f", *order]).filter(F.col("rn") != F.col("rn_ref")).count()
    assert bad == 0


def test_dedupe_and_upsert_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i}", i, f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(8)
    first = {r["k"]: r["v"] for r in M.dedupe_first(df, ["k"], ["t"]).collect()}
    latest = {r["k"]: r["v"] for r in M.latest_per_key(df, ["k"], ["t"]).collect()}
    assert first["hot"] == "v0" and latest["hot"] == "v2997"
    assert len(first) == len(latest) == 1 + sum(1 for i in range(3000) if i % 3)
