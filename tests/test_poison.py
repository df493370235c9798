import json
import os

import pytest
from pyspark.errors import PySparkRuntimeError
from pyspark.sql import functions as F

from cadenza.sources import keyed_table as KT
from cadenza.sources import poison
from cadenza.streaming import changed_files as CF
from cadenza.streaming import streams as ST
from tests.helpers import track_line, write_csv


def spoil(folder, name):
    """A checksum that does not fit: every read of the file fails."""
    with open(os.path.join(folder, f".{name}.crc"), "wb") as f:
        f.write(b"crc\0\0\0\2\0" + b"\1\2\3\4")


def scorer(df):
    return df.withColumn("predicted_popularity", F.col("energy"))


def test_one_unreadable_file_of_eight(spark, tmpdir_fresh):
    inbox, out = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "out")
    for i in range(8):
        write_csv(inbox, f"f{i}.csv", [track_line(song=f"Song{'abcdefgh'[i]}")])
    spoil(inbox, "f5.csv")
    ck = os.path.join(tmpdir_fresh, "ck")
    ST.start_ingest(spark, inbox, out, ck, max_files=8).awaitTermination()
    stats = {r["file_name"]: r for r in spark.read.parquet(os.path.join(out, "stats")).collect()}
    assert {n for n, r in stats.items() if r["outcome"] == "ok"} == {f"f{i}.csv" for i in range(8) if i != 5}
    assert stats["f5.csv"]["outcome"] == "critical_error" and stats["f5.csv"]["attempts"] == 2
    assert "Checksum" in stats["f5.csv"]["error"] and stats["f1.csv"]["error"] is None
    assert spark.read.parquet(os.path.join(out, "ingested")).count() == 7
    alerts = [r["file_name"] for r in spark.read.parquet(os.path.join(out, "alerts")).collect()]
    assert alerts == ["f5.csv"]
    write_csv(inbox, "later.csv", [track_line(song="Later")])  # the next run goes on
    ST.start_ingest(spark, inbox, out, ck, max_files=8).awaitTermination()
    assert spark.read.parquet(os.path.join(out, "ingested")).count() == 8


def test_scoring_goes_on_without_the_unreadable_file(spark, tmpdir_fresh):
    good = os.path.join(tmpdir_fresh, "good")
    table, ledger = os.path.join(tmpdir_fresh, "t"), os.path.join(tmpdir_fresh, "l")
    for name in ("a", "b", "c"):
        write_csv(good, f"{name}.csv", [track_line(song=f"Song{name}")])
    spoil(good, "b.csv")
    ST.score_new_files(spark, good, table, ledger, scorer)
    assert sorted(r["song"] for r in KT.read_table(spark, table).collect()) == ["Songa", "Songc"]
    assert sorted(r["filename"] for r in spark.read.parquet(ledger).collect()) == ["a.csv", "c.csv"]
    failed = spark.read.parquet(ST.failures_dir(ledger)).collect()
    assert [(r["filename"], r["attempts"]) for r in failed] == [("b.csv", 2)]
    os.remove(os.path.join(good, ".b.csv.crc"))  # mended: the next scheduled run takes it
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 1
    assert KT.read_table(spark, table).count() == 3


def test_halving_asks_for_few_attempts_and_retries_once(spark):
    """Which reads are made, and a file that only fails once."""
    asked, once = [], {"g"}

    def read(part):
        asked.append(tuple(part))
        if "x" in part:
            raise OSError("FileNotFoundException: x")
        if once & set(part) and len(part) == 1:
            once.clear()
            raise OSError("EOFException: half written")
        if "g" in part and len(part) > 1:
            raise OSError("EOFException: half written")
        return spark.createDataFrame([(p,) for p in part], "p string"), {part[0]: "empty_file"}

    rows, outcomes, failures = poison.read_apart(list("abcdefgx"), read)
    assert sorted(r.p for r in rows.collect()) == list("abcdefg")
    assert failures == [poison.Failure("x", 2, "FileNotFoundException: x")]
    assert len(asked) <= 4 * 3 + 2 and "x" not in outcomes


def test_a_fault_of_the_cluster_blames_no_file(spark):
    calls = []

    def lost(part):
        calls.append(part)
        raise PySparkRuntimeError("Job aborted: ExecutorLostFailure (executor 3 exited) FAILED_READ_FILE of a.csv")

    with pytest.raises(PySparkRuntimeError):
        poison.read_apart(["a", "b"], lost)
    assert len(calls) == 1
    with pytest.raises(ValueError):
        poison.read_apart(["a"], lambda part: (_ for _ in ()).throw(ValueError("EOFException in our own code")))
    assert poison.read_apart([], lost) == (None, {}, [])


def test_places_follow_changes(tmpdir_fresh):
    def put(name, when, text="x"):
        path = os.path.join(tmpdir_fresh, name)
        with open(path, "w") as f:
            f.write(text)
        os.utime(path, (when, when))

    for name, when in (("b.csv", 100), ("a.csv", 100), ("c.csv", 50), ("n.txt", 10), (".h.csv", 10), ("late.csv", 900)):
        put(name, when)
    until = 500 * 10**6
    first = CF.following(tmpdir_fresh, "*.csv", (-1, ""), 2, until)
    assert [f[0] for f in first] == [(50 * 10**6, "c.csv"), (100 * 10**6, "a.csv")]
    rest = CF.following(tmpdir_fresh, "*.csv", first[-1][0], 10, until)
    assert [f[0][1] for f in rest] == ["b.csv"]  # the late one has not settled
    put("c.csv", 200, "changed")
    assert [(f[0][1], f[2]) for f in CF.following(tmpdir_fresh, "*.csv", rest[-1][0], 10, until)] == [("c.csv", 7)]


def test_a_changed_file_is_scored_again_once(spark, tmpdir_fresh):
    good = os.path.join(tmpdir_fresh, "good")
    table, ledger = os.path.join(tmpdir_fresh, "t"), os.path.join(tmpdir_fresh, "l")
    ck = os.path.join(tmpdir_fresh, "ck")

    def run():
        ST.score_changes_now(spark, good, table, ledger, ck, scorer, max_files=2, settle=0)
        return sorted((r["song"], r["energy"]) for r in KT.read_table(spark, table).collect())

    def entries():
        return sorted(r["filename"] for r in spark.read.parquet(ledger).collect())

    for name in ("a", "b", "c"):
        write_csv(good, f"{name}.csv", [track_line(song=f"Song{name}")])
    assert run() == [("Songa", 0.6), ("Songb", 0.6), ("Songc", 0.6)]
    assert entries() == ["a.csv", "b.csv", "c.csv"]
    version = KT.read_manifest(spark, table)["version"]
    assert run() and KT.read_manifest(spark, table)["version"] == version  # a restart repeats nothing
    path = os.path.join(good, "a.csv")
    write_csv(good, "a.csv", [track_line(song="Songa"), track_line(song="Songz")])
    later = os.stat(os.path.join(good, "c.csv")).st_mtime + 2
    os.utime(path, (later, later))
    assert [s for s, _ in run()] == ["Songa", "Songb", "Songc", "Songz"]
    assert entries() == ["a.csv", "a.csv", "b.csv", "c.csv"]
    assert run() and entries() == ["a.csv", "a.csv", "b.csv", "c.csv"]
    # the fingerprints are those of the scheduled job: nothing is left for it
    assert ST.score_new_files(spark, good, table, ledger, scorer) == 0
    with open(os.path.join(ck, "offsets", "0")) as f:
        assert json.loads(f.read().splitlines()[-1])["name"] == "b.csv"  # a position, not a list
