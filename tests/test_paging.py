import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import paging as PG
from cadenza.operators.paging import By
from cadenza.sources import sinks as SK


def brute(rows, by, limit, offset):
    """Stable sorts, least important column first."""
    out = list(rows)
    for b in reversed(by):
        out.sort(key=lambda r, c=b.column: (r[c] is not None, r[c] if r[c] is not None else 0), reverse=b.descending)
    return out[offset:offset + limit]


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(PG, "DRAWN", 64)
    monkeypatch.setattr(PG, "PIECES", 8)


@pytest.mark.parametrize("by", [[By("v", True), By("id")], [By("s"), By("v"), By("id", True)],
                                [By("t"), By("id")], [By("id", True)]])
def test_deep_pages_by_sorting(spark, small_ranges, by):
    """Nulls, ties in all but the id, text and time keys, every depth."""
    rng = random.Random(3)
    rows = [{"id": i, "v": rng.choice([None, 1.0, 2.5, rng.random()]), "s": rng.choice([None, "", "b", "ä", "zz"]),
             "t": rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 28), rng.randint(0, 23))])} for i in range(3000)]
    df = spark.createDataFrame([(r["id"], r["v"], r["s"], r["t"]) for r in rows],
                               "id long, v double, s string, t timestamp").repartition(5)
    for offset in (0, 7, 1490, 2995, 3000, 5000):
        got = [r["id"] for r in PG.deep_page(df, by, 20, offset, most_rows=60).collect()]
        want = [r["id"] for r in brute(rows, by, 20, offset)]
        assert got == want, (by, offset)


def test_only_a_bounded_range_is_sorted(spark, small_ranges, monkeypatch):
    """At two sizes the rows that are sorted stay under the bound."""
    sizes = []
    original = PG._within
    for n in (4_000, 40_000):
        df = spark.range(n).select(F.col("id"), F.xxhash64("id").alias("h"))
        seen = []
        monkeypatch.setattr(PG, "_within", lambda *a: seen.append(original(*a)) or seen[-1])
        page = PG.deep_page(df, [By("h"), By("id")], 10, n // 2, most_rows=500)
        sizes.append(seen[-1].count())
        monkeypatch.setattr(PG, "_within", original)
        want = [r["id"] for r in df.orderBy("h", "id").offset(n // 2).limit(10).collect()]
        assert [r["id"] for r in page.collect()] == want
    assert max(sizes) <= 500


def test_rows_that_the_order_does_not_tell_apart(spark, small_ranges):
    df = spark.range(2000).select(F.lit(1).alias("k"), "id")
    assert PG.deep_page(df, [By("k")], 10, 1000, most_rows=100).count() == 10
    assert PG.deep_page(df.limit(0), [By("k")], 10, 0).count() == 0
    with pytest.raises(ValueError):
        PG.deep_page(df, [By("k")], 10, -1)


def test_newest_rows_read_few_days(spark, tmpdir_fresh):
    """Ties at midnight, uneven days, rows without a time."""
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(5)
    rows = [(i, base + dt.timedelta(days=rng.randint(0, 29), hours=rng.choice([0, 0, 12, 23])), rng.choice("ab"))
            for i in range(600)] + [(1000 + i, None, "a") for i in range(5)]
    SK.append_history(spark.createDataFrame(rows, "id long, ts timestamp, s string"), tmpdir_fresh, "single", "ts")
    stored = SK.read_history(spark, tmpdir_fresh, "single")

    def want(n, kept=rows):
        key = sorted(kept, key=lambda r: (r[1] is not None, r[1] or base, r[0]), reverse=True)
        return [r[0] for r in key[:n]]

    for n in (1, 30, 100, 598, 603, 900):
        got = PG.newest(stored, "ts", n, ["id"])
        assert [r["id"] for r in got.collect()] == want(n)
    only = PG.newest(stored, "ts", 40, ["id"], F.col("s") == "a")
    assert [r["id"] for r in only.collect()] == want(40, [r for r in rows if r[2] == "a"])
    plan = PG.newest(stored, "ts", 30, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    days = PG.stored_days(stored)
    counts = {r["day"]: r["count"] for r in stored.groupBy("day").count().collect()}
    last, total = 0, 0
    while total < 30:
        total, last = total + counts[days[last]], last + 1
    # the days are doubled, so at most twice the needed ones and one are read
    read = int(plan.split("numPartitions=")[1].split()[0].strip(",)")) if "numPartitions=" in plan else None
    assert read is None or read <= 2 * last + 1
    empty = SK.read_history(spark, tmpdir_fresh, "single").filter("id < 0")
    assert PG.newest(empty, "ts", 10, ["id"]).count() == 0
