import pytest
from pyspark.sql import functions as F

from cadenza.functions.columns import with_audit
from cadenza.operators import history as H
from cadenza.operators import recommend as RC

COLS = ("id long, artist string, song string, genre string, duration_ms int, year int, energy double, "
        "loudness double, danceability double, speechiness double, acousticness double, "
        "instrumentalness double, liveness double, valence double, tempo double, popularity int")


def _cat(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"Artist {i % 3}", f"Ring Song {i}" if i < 8 else f"Other {i}", ["pop", "rock"][i % 2],
                     200000 + 1000 * i, 2000 + i, 0.1 * (i % 7), -5.0 - i, 0.05 * i, 0.1, 0.2, 0.0, 0.1,
                     0.5, 100.0 + i, 40 + i))
    return spark.createDataFrame(rows, COLS)


def test_similar_songs_outcomes(spark):
    cat = _cat(spark)
    assert RC.similar_songs(cat).collect()[0]["message"] == RC.NO_INPUT
    none = RC.similar_songs(cat, song="no such title").collect()
    assert len(none) == 1 and none[0]["message"] == RC.NO_MATCH and none[0]["song"] is None
    got = RC.similar_songs(cat, song="RING").collect()
    assert 1 <= len(got) <= 5 and all(r["message"] is None for r in got)
    scores = [r["similarity_score"] for r in got]
    assert scores == sorted(scores, reverse=True)
    linear = RC.similar_songs(cat, song="RING", candidates="all").collect()
    assert len(linear) == 5 and linear[0]["similarity_score"] >= scores[0]


def test_recommend_names_excludes_self_and_reports_unknown(spark):
    cat = _cat(spark)
    names = spark.createDataFrame([("Ring Song 3",), ("Ring Song 3",), ("Missing",)], "request string")
    got = RC.recommend(cat, names, n=2).collect()
    hits = [r for r in got if r["error"] is None]
    assert len(hits) == 2 and all(r["recommended_song"] != "Ring Song 3" for r in hits)
    miss = [r for r in got if r["error"] is not None]
    assert [(r["request"], r["error"]) for r in miss] == [("Missing", "Song not found")]


def test_with_audit_and_history_kind(spark):
    df = with_audit(spark.range(3), "WEBAPP", run_id="run-1")
    r = df.select("source", "run_id", "created_at").distinct().collect()
    assert len(r) == 1 and r[0]["source"] == "WEBAPP" and r[0]["run_id"] == "run-1"
    with pytest.raises(ValueError, match="unknown prediction type"):
        H.history(df, "created_at", kind="weekly")
    hist = H.history(df.withColumn("id", F.col("id")), "created_at", kind=None, columns=["id", "source"])
    assert hist.count() == 3


def test_lookup_display_fill(spark):
    from cadenza.operators.lookup import lookup_or_error
    cat = spark.createDataFrame([("a", 1, "pop"), ("a", 2, "rock")], "song string, id long, genre string")
    req = spark.createDataFrame([("a",), ("zzz",)], "request string")
    got = {r["request"]: r for r in lookup_or_error(req, cat, "song", "id", ["genre"], display_fill="N/A").collect()}
    assert got["a"]["genre"] == "pop" and got["a"]["id"] == "1"
    assert got["zzz"]["genre"] == "N/A" and got["zzz"]["error"] == "Song not found"


def test_history_prunes_kind_partition(spark, tmpdir_fresh):
    import datetime as dt
    import os

    from cadenza.sources.sinks import append_history, read_history
    rows = spark.createDataFrame(
        [(1, "a", 1.0, "WEBAPP", dt.datetime(2024, 1, 5, 10)), (2, "b", 2.0, "SCHEDULED", dt.datetime(2024, 1, 6, 10))],
        "id long, song string, predicted_popularity double, source string, created_at timestamp")
    path = os.path.join(tmpdir_fresh, "hist")
    append_history(rows, path, "single")
    append_history(rows.withColumn("id", F.col("id") + 10), path, "multiple")
    h = H.history(read_history(spark, path, "single"), "created_at", "2024-01-05", "2024-01-05", "next_midnight",
                  source="ALL", kind="single", columns=["id", "song", "source"])
    assert sorted(r["id"] for r in h.collect()) == [1]
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        h.explain(mode="formatted")
    assert "PartitionFilters: [isnotnull(day" in buf.getvalue()


def test_similar_record(spark):
    cat = _cat(spark)
    rec = RC.similar_record(RC.similar_songs(cat, song="RING"), "RING", None).collect()[0]
    assert rec["reference_song"] == "RING" and rec["message"] is None
    scores = [x["similarity_score"] for x in rec["similar_songs"]]
    assert 1 <= len(scores) <= 5 and scores == sorted(scores, reverse=True)
    none = RC.similar_record(RC.similar_songs(cat, song="zzz"), "zzz", None).collect()[0]
    assert none["similar_songs"] == [] and none["message"] == RC.NO_MATCH


def test_recommend_record(spark):
    cat = _cat(spark)
    names = spark.createDataFrame([("Ring Song 3",), ("Missing",)], "request string")
    rec = RC.recommend_record(RC.recommend(cat, names, n=2)).collect()[0]
    assert rec["input_songs"] == ["Missing", "Ring Song 3"]
    assert rec["output"]["Missing"]["error"] == "Song not found"
    assert rec["output"]["Ring Song 3"]["recommended_song"] not in (None, "Ring Song 3")


def test_category_tokens_skip_empty_set(spark):
    from cadenza.operators.lookup import category_tokens, valid_category
    cat = spark.createDataFrame([("hip hop, pop, R&B",), ("set()",), ("rock",)], "genre string")
    assert sorted(r["token"] for r in category_tokens(cat, "genre").collect()) == ["hip hop", "pop", "r&b", "rock"]
    req = spark.createDataFrame([("Pop",), ("set()",), ("jazz",)], "request string")
    got = {r["request"]: r["valid"] for r in valid_category(req, cat, "genre").collect()}
    assert got == {"Pop": True, "set()": False, "jazz": False}
