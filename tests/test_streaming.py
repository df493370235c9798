import os

from pyspark.sql import functions as F

from cadenza.operators import scoring as SC
from cadenza.sources import keyed_table as KT
from cadenza.streaming import streams as ST
from tests.helpers import track_line, write_csv


def test_ingest_stream_two_runs_and_routes(spark, tmpdir_fresh):
    inbox = os.path.join(tmpdir_fresh, "inbox")
    out = os.path.join(tmpdir_fresh, "out")
    ck = os.path.join(tmpdir_fresh, "ck")
    write_csv(inbox, "clean data.csv", [track_line(song="Alpha"), track_line(song="Beta")])
    write_csv(inbox, "mixed.csv", [track_line(song="Gamma"), track_line(song="Delta", year="2024")])
    q = ST.start_ingest(spark, inbox, out, ck, max_files=1)
    q.awaitTermination()
    stats = spark.read.parquet(os.path.join(out, "stats"))
    assert stats.select("batch_id").distinct().count() == 2  # one file per micro-batch
    # second run: only the new files are processed (header-only, unreadable)
    write_csv(inbox, "empty.csv", [])
    write_csv(inbox, "junk.csv", ["not,a,track", "x,y"])
    write_csv(inbox, "other.csv", ["Song,pop"], header="song,genre")
    q = ST.start_ingest(spark, inbox, out, ck, max_files=1)
    q.awaitTermination()
    stats = {r["file_name"]: r for r in spark.read.parquet(os.path.join(out, "stats")).collect()}
    assert stats["clean data.csv"]["invalid_rows"] == 0 and stats["mixed.csv"]["invalid_rows"] == 1
    assert (stats["clean data.csv"]["total_rows"], stats["clean data.csv"]["outcome"]) == (2, "ok")
    assert stats["empty.csv"]["outcome"] == "empty_file"
    assert stats["junk.csv"]["outcome"] == "file_read_error" and stats["junk.csv"]["corrupt_rows"] == 2
    assert stats["other.csv"]["outcome"] == "validation_error"
    routed = spark.read.option("header", True).csv(os.path.join(out, "routed"))
    got = sorted((r["route"], r["dest_name"], r["song"]) for r in routed.collect())
    assert got == [("bad", "invalid_mixed.csv", "Delta"), ("good", "clean data.csv", "Alpha"),
                   ("good", "clean data.csv", "Beta"), ("good", "valid_mixed.csv", "Gamma")]
    ingested = spark.read.parquet(os.path.join(out, "ingested"))
    assert sorted(r["song"] for r in ingested.collect()) == ["Alpha", "Beta", "Gamma"]
    assert dict(ingested.dtypes)["year"] == "int" and ingested.filter("ingestion_timestamp is null").count() == 0
    alerts = spark.read.parquet(os.path.join(out, "alerts")).collect()
    assert {a["file_name"] for a in alerts} == {"mixed.csv", "empty.csv", "junk.csv", "other.csv"}


def test_scoring_stream_upserts_and_ledger(spark, tmpdir_fresh):
    good = os.path.join(tmpdir_fresh, "good")
    table = os.path.join(tmpdir_fresh, "pred")
    ledger = os.path.join(tmpdir_fresh, "ledger")
    ck = os.path.join(tmpdir_fresh, "ck")

    def scorer(df):
        return df.withColumn("predicted_popularity",
                             SC.linear_score({"energy": 10.0, "loudness": 1.0}, 40.0))

    write_csv(good, "a.csv", [track_line(song="Same Song"), track_line(song="Song_7"),
                              track_line(song="Other", duration="abc")])
    ST.start_scoring(spark, good, table, ledger, ck, scorer, max_files=1).awaitTermination()
    write_csv(good, "b.csv", [track_line(song="Same Song", tempo="99.0")])
    ST.start_scoring(spark, good, table, ledger, ck, scorer, max_files=1).awaitTermination()
    rows = KT.read_table(spark, table).collect()
    assert len(rows) == 1  # one key; Song_7 and the bad row were skipped
    assert rows[0]["file_name"] == "b.csv" and rows[0]["created_at"] < rows[0]["processed_at"]
    led = spark.read.parquet(ledger)
    assert sorted(r["filename"] for r in led.collect()) == ["a.csv", "b.csv"]
    assert led.filter(F.col("successful_records") != 1).count() == 0
    # a scheduled run after the stream finds nothing new
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 0


def test_replayed_batches_are_idempotent(spark, tmpdir_fresh):
    inbox = os.path.join(tmpdir_fresh, "inbox")
    out = os.path.join(tmpdir_fresh, "out")
    write_csv(inbox, "f.csv", [track_line(song="Alpha"), track_line(song="Beta", year="1800")])
    files = spark.read.format("binaryFile").load(inbox).select("path", "length", "modificationTime")
    ST.ingest_batch(spark, files, out, 7)
    ST.ingest_batch(spark, files, out, 7)  # a replay after a failure
    assert spark.read.parquet(os.path.join(out, "stats")).count() == 1
    assert spark.read.option("header", True).csv(os.path.join(out, "routed")).count() == 2

    table = os.path.join(tmpdir_fresh, "pred")
    ledger = os.path.join(tmpdir_fresh, "ledger")

    def scorer(df):
        return df.withColumn("predicted_popularity", F.lit(1.0))

    ST.score_batch(spark, files, table, ledger, 0, scorer)
    ST.score_batch(spark, files, table, ledger, 0, scorer)
    assert KT.read_table(spark, table).count() == 2
    assert spark.read.parquet(ledger).count() == 1
    assert KT.read_manifest(spark, table)["version"] == 0


def test_score_new_files_reprocesses_changed(spark, tmpdir_fresh):
    good = os.path.join(tmpdir_fresh, "good")
    table = os.path.join(tmpdir_fresh, "pred")
    ledger = os.path.join(tmpdir_fresh, "ledger")

    def scorer(df):
        return df.withColumn("predicted_popularity", F.col("energy") * 100)

    write_csv(good, "a.csv", [track_line(song="One")])
    write_csv(good, "b.CSV", [track_line(song="Two")])
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 2
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 0  # nothing new: skip
    import time
    time.sleep(1.1)
    write_csv(good, "a.csv", [track_line(song="One"), track_line(song="Three")])  # changed file
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 1
    assert sorted(r["song"] for r in KT.read_table(spark, table).collect()) == ["One", "Three", "Two"]
    led = spark.read.parquet(ledger)
    assert led.filter(F.col("fingerprint").isNull()).count() == 0 and led.count() == 3


def test_cli_rescore_with_coefficients(spark, tmpdir_fresh, capsys):
    import json as _json

    from cadenza import cli
    good = os.path.join(tmpdir_fresh, "good")
    write_csv(good, "a.csv", [track_line(song="One"), track_line(song="Two", genre="rock")])
    coef = os.path.join(tmpdir_fresh, "coef.json")
    with open(coef, "w") as f:
        _json.dump({"intercept": 10.0, "features": {"energy": 50.0}, "category": ["genre", {"rock": 5.0}]}, f)
    args = ["rescore", "--good", good, "--table", os.path.join(tmpdir_fresh, "t"),
            "--ledger", os.path.join(tmpdir_fresh, "l"), "--coefficients", coef]
    assert cli.main(args) == 0
    assert _json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"files_scored": 1, "skipped": False}
    got = {r["song"]: r["predicted_popularity"] for r in KT.read_table(spark, os.path.join(tmpdir_fresh, "t")).collect()}
    assert got == {"One": 40.0, "Two": 45.0}
    assert cli.main(args) == 0
    assert _json.loads(capsys.readouterr().out.strip().splitlines()[-1])["skipped"] is True


def test_validation_failure_becomes_critical_error(spark, tmpdir_fresh):
    from cadenza.operators.quality import Expectation
    inbox = os.path.join(tmpdir_fresh, "inbox")
    out = os.path.join(tmpdir_fresh, "out")
    write_csv(inbox, "f.csv", [track_line(song="Alpha")])
    files = spark.read.format("binaryFile").load(inbox).select("path", "length", "modificationTime")
    bad_suite = [Expectation("not_null", "no_such_column")]
    ST.ingest_batch(spark, files, out, 0, suite=bad_suite)
    st = spark.read.parquet(os.path.join(out, "stats")).collect()
    assert [(r["file_name"], r["outcome"]) for r in st] == [("f.csv", "critical_error")]
    assert "no_such_column" in st[0]["error"]
    assert spark.read.parquet(os.path.join(out, "alerts")).count() == 1
    import pytest
    with pytest.raises(ValueError):
        ST.ingest_batch(spark, files, out, 1, suite=bad_suite, on_error="raise")


def test_scoring_needs_six_columns_in_any_order(spark, tmpdir_fresh):
    good = os.path.join(tmpdir_fresh, "good")
    write_csv(good, "ok.csv", [track_line(song="Fine")])
    write_csv(good, "six.csv", ["Other,200000.0,2001.0,0.5,-5.0,pop"],
              header="song,duration_ms,year,energy,loudness,genre")
    write_csv(good, "turned.csv", ["pop,-5.0,0.5,2001,200000,Turned"],
              header="genre,loudness,energy,year,duration_ms,song")
    write_csv(good, "five.csv", ["Five,200000,2001,0.5,-5.0"], header="song,duration_ms,year,energy,loudness")
    write_csv(good, "UPPER.CSV", [track_line(song="Loud")])

    def scorer(df):
        return df.withColumn("predicted_popularity", F.col("energy"))

    table, ledger = os.path.join(tmpdir_fresh, "t"), os.path.join(tmpdir_fresh, "l")
    ST.start_scoring(spark, good, table, ledger, os.path.join(tmpdir_fresh, "ck"), scorer).awaitTermination()
    got = {r["song"]: (r["duration_ms"], r["year"], r["energy"]) for r in KT.read_table(spark, table).collect()}
    assert got == {"Fine": (200000, 2001, 0.6), "Loud": (200000, 2001, 0.6), "Other": (200000, 2001, 0.5),
                   "Turned": (200000, 2001, 0.5)}
    assert sorted(r["filename"] for r in spark.read.parquet(ledger).collect()) == [
        "UPPER.CSV", "ok.csv", "six.csv", "turned.csv"]


def test_first_row_in_a_batch_then_later_batch_wins(spark, tmpdir_fresh, monkeypatch):
    """Both row orders of one key, against the row loop."""
    def line(song, energy):
        return f"{song},200000,2001,{energy},-5.0,pop"

    header = "song,duration_ms,year,energy,loudness,genre"
    files = {"a.csv": [("K", 0.1), ("L", 0.2), ("K", 0.9), ("M", 0.3), ("K", 0.4), ("L", 0.5)],
             "b.csv": [("K", 0.9), ("K", 0.1), ("N", 0.7)]}
    monkeypatch.setattr(ST, "STORE_ROWS", 3)
    good = os.path.join(tmpdir_fresh, "good")
    for name, rows in files.items():
        write_csv(good, name, [line(*r) for r in rows], header=header)
    want, stored = {}, {}
    for name, rows in sorted(files.items()):
        stored[name] = 0
        for i in range(0, len(rows), 3):
            seen = {}
            for song, energy in rows[i:i + 3]:
                seen.setdefault(song, energy)
            want.update(seen)
            stored[name] += len(seen)
    table, ledger = os.path.join(tmpdir_fresh, "t"), os.path.join(tmpdir_fresh, "l")
    assert ST.score_new_files(spark, good, table, ledger, lambda d: d.withColumn("predicted_popularity", F.lit(1.0)),
                              max_files=1) == 2
    assert {r["song"]: r["energy"] for r in KT.read_table(spark, table).collect()} == want
    assert {r["filename"]: r["successful_records"] for r in spark.read.parquet(ledger).collect()} == stored


def test_accepted_values_do_not_turn_null(spark, tmpdir_fresh):
    inbox, out = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "out")
    write_csv(inbox, "f.csv", [track_line(song="Alpha", year="2001.0", pop="50.0")])
    files = spark.read.format("binaryFile").load(inbox).select("path", "length")
    ST.ingest_batch(spark, files, out, 0)
    got = spark.read.parquet(os.path.join(out, "ingested")).collect()
    assert [(r["year"], r["popularity"]) for r in got] == [(2001, 50)]


def test_a_fault_fails_the_batch(spark, tmpdir_fresh, monkeypatch):
    import pytest
    inbox, out = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "out")
    write_csv(inbox, "f.csv", [track_line(song="Alpha")])
    files = spark.read.format("binaryFile").load(inbox).select("path", "length")
    with monkeypatch.context() as m:
        m.setattr(ST.Q, "write_routed", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("disk full")))
        with pytest.raises(RuntimeError, match="disk full"):
            ST.ingest_batch(spark, files, out, 0)
    ST.ingest_batch(spark, files, out, 0)  # taken up again
    st = spark.read.parquet(os.path.join(out, "stats")).collect()
    assert [(r["file_name"], r["outcome"], r["valid_rows"]) for r in st] == [("f.csv", "ok", 1)]


def test_cli_ingest_once(spark, tmpdir_fresh):
    from cadenza import cli
    inbox, out = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "out")
    write_csv(inbox, "one.csv", [track_line(song="Alpha"), track_line(song="Beta", pop="150")])
    assert cli.main(["ingest", "--inbox", inbox, "--out", out,
                     "--checkpoint", os.path.join(tmpdir_fresh, "ck")]) == 0
    st = spark.read.parquet(os.path.join(out, "stats")).collect()
    assert [(r["file_name"], r["valid_rows"], r["invalid_rows"], r["outcome"]) for r in st] == [("one.csv", 1, 1, "ok")]


def test_cli_rescore_with_saved_model(spark, tmpdir_fresh, capsys):
    import json as _json

    from cadenza import cli
    train = spark.createDataFrame(
        [(200000 + i, 1990 + i % 30, 0.5, -5.0, "pop" if i % 2 else "rock", float(i % 100)) for i in range(100)],
        "duration_ms int, year int, energy double, loudness double, genre string, popularity double")
    model = SC.train(train, ["duration_ms", "year", "energy", "loudness", "genre"], "popularity",
                     categorical=["genre"])
    mpath = os.path.join(tmpdir_fresh, "model")
    model.save(mpath)
    good = os.path.join(tmpdir_fresh, "good")
    write_csv(good, "a.csv", [track_line(song="One"), track_line(song="Two", genre="jazz")])
    args = ["rescore", "--good", good, "--table", os.path.join(tmpdir_fresh, "t"),
            "--ledger", os.path.join(tmpdir_fresh, "l"), "--model", mpath]
    assert cli.main(args) == 0
    assert _json.loads(capsys.readouterr().out.strip().splitlines()[-1])["files_scored"] == 1
    got = KT.read_table(spark, os.path.join(tmpdir_fresh, "t")).collect()
    assert sorted(r["song"] for r in got) == ["One", "Two"]  # an unseen genre is kept, not fatal
    assert all(r["predicted_popularity"] is not None for r in got)
