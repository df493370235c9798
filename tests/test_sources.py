import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cadenza.sources import files as FS
from cadenza.sources import keyed_table as KT
from cadenza.sources import sinks as SK
from cadenza.sources import synth as SY
from tests.helpers import track_line, write_csv


def test_scan_tracks_quotes_commas_and_types(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "a.csv", [
        track_line(artist='"Earth, Wind & Fire"', song='"Say ""Hi"""'),
        track_line(duration="3.7e5", year="NaN"),
    ])
    df = FS.scan_tracks(spark, tmpdir_fresh)
    rows = df.orderBy("artist").collect()
    assert rows[1]["artist"] == "Earth, Wind & Fire" and rows[1]["song"] == 'Say "Hi"'
    assert rows[0]["duration_ms"] == 370000 and rows[0]["year"] is None
    assert rows[0]["file_name"] == "a.csv" and rows[0]["explicit"] is False


def test_required_columns_and_legacy_names(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "b.csv", ["x,1"], header="song,duration_ms")
    with pytest.raises(ValueError, match="missing columns"):
        FS.scan_tracks(spark, tmpdir_fresh)
    assert FS.require_columns(["a", "b"], ["a", "c"]) == ["c"]


def test_header_only_file_and_corrupt_lines(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "empty.csv", [])
    write_csv(tmpdir_fresh, "bad.csv", [track_line(), track_line() + ",extra,cols"])
    good, bad = FS.scan_corrupt(spark, tmpdir_fresh)
    assert good.count() == 1 and bad.count() == 1


def test_corrupt_lines_by_header_name(spark, tmpdir_fresh):
    """Columns in another order are read by name; a value of another type
    makes its line corrupt."""
    from tests.helpers import HEADER
    names = HEADER.split(",")
    line = track_line(song="Turned", year="1999").split(",")
    write_csv(tmpdir_fresh, "turned.csv", [",".join(reversed(line))], header=",".join(reversed(names)))
    write_csv(tmpdir_fresh, "plain.CSV", [track_line(song="Plain"), track_line(song="Bad", year="soon")])
    write_csv(tmpdir_fresh, "none.csv", [])
    good, bad = FS.scan_corrupt(spark, tmpdir_fresh)
    assert {(r["song"], r["year"], r["file_name"]) for r in good.collect()} == {
        ("Turned", 1999, "turned.csv"), ("Plain", 2001, "plain.CSV")}
    assert [(r["file_name"], "soon" in r[FS.CORRUPT]) for r in bad.collect()] == [("plain.CSV", True)]
    assert good.count() == 2 and bad.count() == 1 and bad.select(FS.CORRUPT).count() == 1
    write_csv(tmpdir_fresh, "short.csv", ["x,1"], header="song,duration_ms")
    with pytest.raises(ValueError, match="missing columns"):
        FS.scan_corrupt(spark, tmpdir_fresh)


def test_discover_files_case_and_fingerprint(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "one.csv", [track_line()])
    write_csv(tmpdir_fresh, "two.CSV", [track_line()])
    with open(os.path.join(tmpdir_fresh, "notes.txt"), "w") as f:
        f.write("x")
    strict = {r["filename"] for r in FS.discover_files(spark, tmpdir_fresh).collect()}
    loose = {r["filename"] for r in FS.discover_files(spark, tmpdir_fresh, case_sensitive=False).collect()}
    assert strict == {"one.csv"} and loose == {"one.csv", "two.CSV"}
    fp = FS.discover_files(spark, tmpdir_fresh).collect()[0]["fingerprint"]
    size, micros = fp.split("_")
    assert int(size) == os.path.getsize(os.path.join(tmpdir_fresh, "one.csv")) and int(micros) > 0
    # a rewrite under the same name changes the fingerprint
    write_csv(tmpdir_fresh, "one.csv", [track_line(), track_line()])
    assert FS.discover_files(spark, tmpdir_fresh).collect()[0]["fingerprint"] != fp
    recent = FS.discover_files(spark, tmpdir_fresh, within=dt.timedelta(days=1))
    assert recent.count() == 1


def test_copy_with_count_and_export(spark, tmpdir_fresh):
    df = spark.range(25).withColumn("x", F.col("id") * 2)
    assert SK.copy_with_count(df, os.path.join(tmpdir_fresh, "copy")) == 25
    SK.export_csv(df, os.path.join(tmpdir_fresh, "exp"))
    assert spark.read.option("header", True).csv(os.path.join(tmpdir_fresh, "exp")).count() == 25


def test_history_by_kind_keeps_columns_and_prunes_days(spark, tmpdir_fresh):
    from cadenza.operators.history import history
    h = os.path.join(tmpdir_fresh, "hist")
    days = spark.range(6).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400))
    single = days.select("id", F.lit("s").alias("song"), F.lit(1.5).alias("predicted_popularity"), "created_at")
    similar = days.select("id", F.lit("r").alias("reference_song"), "created_at")
    SK.append_history(single, h, "single")
    SK.append_history(similar, h, "similar")
    SK.append_history(similar, h, "similar")
    got = SK.read_history(spark, h, "single")
    assert got.count() == 6 and {"song", "predicted_popularity"} <= set(got.columns)
    assert SK.read_history(spark, h, "similar").count() == 12
    two = history(got, "created_at", dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert sorted(r["id"] for r in two.collect()) == [1, 2, 3]  # the next midnight is included
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_copied_csv_reads_back(spark, tmpdir_fresh):
    rows = [('He said "hi", ok', 1), ("plain", 2), ('"', 3), (None, 4)]
    df = spark.createDataFrame(rows, "t string, n int")
    path = os.path.join(tmpdir_fresh, "copy")
    assert SK.copy_with_count(df, path) == 4
    back = spark.read.option("header", True).option("escape", '"').schema("t string, n int").csv(path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_synth_and_split(spark):
    full = SY.synth_tracks(spark, 500, seed=1)
    assert len(full.columns) == 19  # 18 columns + file name
    r = full.agg(F.min("year"), F.max("year"), F.countDistinct("file_name")).collect()[0]
    assert r[0] >= 1990 and r[1] <= 2024 and r[2] == 10
    small = SY.synth_tracks(spark, 100, seed=2, profile="small")
    assert small.select("song").distinct().count() == 100
    parts = SY.split_samples(spark.range(2000), 4, ["id"], seed=3)
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert set(counts) == {1, 2, 3, 4} and all(350 < c < 650 for c in counts.values())


def test_register_upload(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "up.csv", [track_line()])
    df = spark.read.option("header", True).csv(tmpdir_fresh)
    got = FS.register_upload(df).collect()
    assert [r["filename"] for r in got] == ["up.csv"] and got[0]["uploaded_at"] is not None


def _kv(spark, rows):
    return spark.createDataFrame(rows, "k long, made string, v string")


def _stored(spark, t):
    return sorted((tuple(r) for r in KT.read_table(spark, t).collect()), key=str)


def test_upsert_touches_only_needed_buckets_and_keeps_identity(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "keyed")
    assert KT.read_table(spark, t) is None
    assert KT.upsert(spark, _kv(spark, [(k, "m0", "a") for k in range(200)]), t, ["k"], ["made"], buckets=16) == 0
    upd = _kv(spark, [(5, "m1", "b"), (500, "m1", "c"), (None, "m1", "n")])
    assert KT.upsert(spark, upd, t, ["k"], ["made"], buckets=99) == 1  # the stored bucket count holds
    assert KT.upsert(spark, _kv(spark, [(None, "m2", "o")]), t, ["k"], ["made"]) == 2
    want = [(k, "m0", "b" if k == 5 else "a") for k in range(200)] + [(500, "m1", "c"), (None, "m1", "o")]
    assert _stored(spark, t) == sorted(want, key=str)
    manifest = KT.read_manifest(spark, t)
    assert manifest["buckets"] == 16 and len({b for b, v in manifest["folders"].items() if v > 0}) <= 3
    with pytest.raises(ValueError, match="keyed by"):
        KT.upsert(spark, upd, t, ["v"])


def test_a_batch_of_a_source_is_taken_once(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "keyed")
    assert KT.upsert(spark, _kv(spark, [(1, "m", "a")]), t, ["k"], source="s", batch=4) == 0
    assert KT.upsert(spark, _kv(spark, [(1, "m", "b")]), t, ["k"], source="s", batch=4) == 0
    assert KT.upsert(spark, _kv(spark, [(1, "m", "c")]), t, ["k"], source="other", batch=0) == 1
    assert _stored(spark, t) == [(1, "m", "c")]


def test_crash_between_write_and_commit_changes_nothing(spark, tmpdir_fresh, monkeypatch):
    t = os.path.join(tmpdir_fresh, "keyed")
    KT.upsert(spark, _kv(spark, [(k, "m", "a") for k in range(20)]), t, ["k"], buckets=4)
    before = _stored(spark, t)
    with monkeypatch.context() as m:
        m.setattr(KT, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            KT.upsert(spark, _kv(spark, [(3, "m", "z")]), t, ["k"])
    assert _stored(spark, t) == before
    KT.upsert(spark, _kv(spark, [(3, "m", "z")]), t, ["k"])  # the retry
    assert dict((k, v) for k, _, v in _stored(spark, t))[3] == "z" and len(_stored(spark, t)) == 20


def test_unreadable_table_is_an_error_and_stays(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "keyed")
    KT.upsert(spark, _kv(spark, [(k, "m", "a") for k in range(20)]), t, ["k"], buckets=2)
    part = os.path.join(t, "v=0", "bucket=0")
    names = [n for n in os.listdir(part) if n.endswith(".parquet")]
    kept = {n: open(os.path.join(part, n), "rb").read() for n in names}
    for n in names:
        with open(os.path.join(part, n), "wb") as f:
            f.write(b"not parquet")
        crc = os.path.join(part, f".{n}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    with pytest.raises(Exception):
        KT.upsert(spark, _kv(spark, [(k, "m", "z") for k in range(20)]), t, ["k"])
    for n, raw in kept.items():
        with open(os.path.join(part, n), "wb") as f:
            f.write(raw)
    assert [v for _, _, v in _stored(spark, t)] == ["a"] * 20


def test_two_writers_of_one_version(spark, tmpdir_fresh):
    t = os.path.join(tmpdir_fresh, "keyed")
    KT.upsert(spark, _kv(spark, [(1, "m", "a")]), t, ["k"])
    stale = KT.read_manifest(spark, t)
    with pytest.raises(RuntimeError, match="another writer"):
        KT._commit(spark, t, stale)


def test_exact_split_samples(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    got = SY.split_samples(df, 4, ["k"], seed=5, exact=True)
    sizes = {r["part"]: r["count"] for r in got.groupBy("part").count().collect()}
    assert sizes == {1: 26, 2: 26, 3: 26, 4: 26}
    assert got.groupBy("part", "k").count().filter(F.col("count") > 1).count() == 0
    again = SY.split_samples(df.repartition(5), 4, ["k"], seed=5, exact=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_layouts_are_read_by_name(spark, tmpdir_fresh):
    from tests.helpers import HEADER
    names = HEADER.split(",")
    need = ["song", "year", "key"]
    write_csv(tmpdir_fresh, "a.csv", [track_line(song="A1"), track_line(song="A2")])
    write_csv(tmpdir_fresh, "b.csv", ["x"], header="song,genre")
    write_csv(tmpdir_fresh, "c.csv", [track_line(song="C1")],
              header=HEADER.replace("key", "feature1").replace("mode", "feature2"))
    write_csv(tmpdir_fresh, "r.csv", [",".join(reversed(track_line(song="R1").split(",")))],
              header=",".join(reversed(names)))
    write_csv(tmpdir_fresh, "bad.csv", [track_line(song="B1"), track_line() + ",more"])
    open(os.path.join(tmpdir_fresh, "none.csv"), "w").close()
    paths = [os.path.join(tmpdir_fresh, f"{f}.csv") for f in ("a", "b", "c", "r", "bad", "none")]
    rows, outcomes = FS.read_layouts(spark, paths, need)
    assert {os.path.basename(p): o for p, o in outcomes.items()} == {"b.csv": "validation_error", "none.csv": "empty_file"}
    rows = rows.persist()
    good = rows.filter(F.col(FS.CORRUPT).isNull())
    assert sorted((r.song, r.year, r["key"]) for r in good.collect()) == [
        (s, "2001", "5") for s in ("A1", "A2", "B1", "C1", "R1")]
    assert rows.filter(F.col(FS.CORRUPT).isNotNull()).count() == 1
    in_order = good.filter("file_name = 'a.csv'").orderBy("_start", "_row").collect()
    assert [r.song for r in in_order] == ["A1", "A2"]
    rows.unpersist()


def test_quoted_line_break(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "m.csv", [track_line(artist='"two\nlines"', song="M1"), track_line(song="M2")])
    df = FS.scan_tracks(spark, tmpdir_fresh, multi_line=True)
    assert sorted((r.artist, r.song) for r in df.collect()) == [("Artist A", "M2"), ("two\nlines", "M1")]
    rows, _ = FS.read_layouts(spark, [os.path.join(tmpdir_fresh, "m.csv")], ["song"], multi_line=True)
    assert sorted(r.song for r in rows.collect()) == ["M1", "M2"]


def test_extra_unnamed_column_keeps_the_18(spark, tmpdir_fresh):
    from tests.helpers import HEADER
    write_csv(tmpdir_fresh, "semi.csv", [track_line(song="Extra") + ",junk"], header=HEADER + ",")
    df = FS.scan_tracks(spark, tmpdir_fresh)
    rows = df.collect()
    assert len(df.columns) == 19 and df.columns[-1] == "file_name"   # 18 track columns + file name
    assert rows[0]["song"] == "Extra" and rows[0]["genre"] == "pop"


def _files(folder):
    return [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")]


def test_few_updates_write_few_rows(spark, tmpdir_fresh):
    """64 of 20,000 keys: only changed rows are written; the first commit
    leaves a file for each bucket."""
    t = os.path.join(tmpdir_fresh, "keyed")
    first = spark.range(20_000, numPartitions=20).selectExpr("id as k", "'m0' as made", "'a' as v")
    KT.upsert(spark, first, t, ["k"], ["made"], buckets=16)
    assert len(_files(os.path.join(t, "v=0"))) == 16
    upd = spark.range(0, 20_000, 313).selectExpr("id as k", "'m1' as made", "'b' as v").limit(64)
    KT.upsert(spark, upd, t, ["k"], ["made"])
    written = spark.read.parquet(os.path.join(t, "v=1")).count()
    assert written == 64
    got = KT.read_table(spark, t)
    assert got.count() == 20_000 and got.filter("v = 'b' AND made = 'm0' AND k % 313 = 0").count() == 64
    assert sum(n for rows in KT.read_manifest(spark, t)["rows"].values() for n in rows) == 20_064


@pytest.mark.parametrize("share,folders", [(KT.FOLD_SHARE, KT.FOLD_FOLDERS), (10.0, 3), (10.0, 100)])
def test_changes_fold_and_read_like_a_dict(spark, tmpdir_fresh, monkeypatch, share, folders):
    """Many small commits against a plain dict, null keys and new columns
    included; a bucket's changes stay few."""
    import random
    monkeypatch.setattr(KT, "FOLD_SHARE", share)
    monkeypatch.setattr(KT, "FOLD_FOLDERS", folders)
    rng = random.Random(6)
    t, want = os.path.join(tmpdir_fresh, "keyed"), {}
    for step in range(7):
        keys = rng.sample([None, *range(40)], rng.randint(1, 12) if step else 30)
        rows = [(k, f"made{step}", f"v{step}") for k in keys]
        KT.upsert(spark, _kv(spark, rows), t, ["k"], ["made"], buckets=3)
        for k, made, v in rows:
            want[k] = (want[k][0] if k in want else made, v)
        manifest = KT.read_manifest(spark, t)
        assert all(len(c) < folders for c in manifest["changes"].values())
    assert _stored(spark, t) == sorted(((k, *x) for k, x in want.items()), key=str)
    wide = spark.createDataFrame([(1, "late", "w", 5)], "k long, made string, v string, extra int")
    KT.upsert(spark, wide, t, ["k"], ["made"])
    assert {r["k"]: r["extra"] for r in KT.read_table(spark, t).collect()}[1] == 5
