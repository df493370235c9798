import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cadenza.llm import mixing, queries
from tests.llm.frames import as_set, awkward, empty, frame
from tools.oracle_check import compare


def water_fill(sizes, weights, budget):
    """Targets by bisection of the level."""
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        total = sum(min(2 * s, mid * w) for s, w in zip(sizes, weights))
        lo, hi = (mid, hi) if total < budget else (lo, mid)
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


def test_awkward_frame(spark):
    rows = awkward()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    got = mixing.plan(frame(spark)).collect()
    assert sorted(r["size"] for r in got) == sorted(size)
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    own = [sum(s for s, r in zip(size, rows) if r[3] == n) for n in names]
    targets = water_fill(own, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size))
    for name, total, target in zip(names, own, targets):
        mine = [r for r in got if r["source"] == name]
        assert all(r["source_size"] == total for r in mine)
        assert all(r["target"] == pytest.approx(target) for r in mine)
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - target) <= max(r["size"] for r in mine)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_reruns_and_partitions_agree(spark):
    a = mixing.plan(frame(spark).repartition(7))
    b = mixing.plan(frame(spark).repartition(3))
    cols = ["doc_id", "source", "size", "target", "taken"]
    assert as_set(a.select(cols)) == as_set(b.select(cols))


def test_totals_by_shuffle_agree(spark, monkeypatch):
    cols = ["doc_id", "source", "size", "target", "taken"]
    want = as_set(mixing.plan(frame(spark)).select(cols))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", -1)
    assert as_set(mixing.plan(frame(spark)).select(cols)) == want


def test_hot_source_and_time_ranges(spark, monkeypatch):
    rows = [(i, "w " * (i % 9 + 1), "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(3000)]
    want = as_set(mixing.plan(frame(spark, rows)).select("doc_id", "taken"))
    monkeypatch.setattr(mixing, "TIME_RANGES", 3)
    assert as_set(mixing.plan(frame(spark, rows)).select("doc_id", "taken")) == want


def test_mix_repeats_rows(spark):
    docs = frame(spark)
    taken = mixing.plan(docs).filter("size > 0").groupBy("doc_id").agg(F.sum("taken").alias("n"))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = out.withColumn("w", mixing.size_of(F.col("text"))).groupBy("doc_id").agg(F.sum("w").alias("n"))
    assert as_set(words) == as_set(taken.filter("n > 0"))


def test_empty(spark):
    assert mixing.plan(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    blank = frame(spark, [(1, None, None, None, None), (2, "  ", "en", "a", 0)])
    assert [r["taken"] for r in mixing.plan(blank).collect()] == [0, 0]


def test_the_edge_is_cut_until_it_is_small(spark, monkeypatch):
    rows = [(i if i % 5 else None, "w " * (i % 9 + 1) + str(i % 700), "en", "hot" if i % 3 else f"s{i % 4}", 1)
            for i in range(3000)]
    cols = ["doc_id", "size", "taken"]
    want = as_set(mixing.plan(frame(spark, rows)).select(cols))
    monkeypatch.setattr(mixing, "TIME_RANGES", 5)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 4)
    assert as_set(mixing.plan(frame(spark, rows)).select(cols)) == want


def test_rows_without_an_id_are_dealt_like_others(spark):
    """Their shuffle keys differ by text, and the result equals the SQL."""
    rows = [(None, "w " * (i % 7 + 1) + str(i), "en", f"s{i % 2}", 1) for i in range(600)]
    got = mixing.plan(frame(spark, rows))
    assert got.select("finish", "source").distinct().count() == 600
    con = duckdb.connect()
    con.register("documents", frame(spark, rows, extra=False).toPandas())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    status, msg = compare(got.select(cols).toPandas(), con.execute(queries.ORACLES["op1_mixing"]).fetchdf())
    assert status == "OK", msg
