"""The 13-rule suite on raw track files: the hand-written edge cases."""

from pyspark.sql import functions as F

from cadenza.operators import quality as Q
from cadenza.schema import track_suite
from cadenza.sources import files as FS
from tests.helpers import track_line, write_csv


def _failed(spark, folder):
    df = FS.scan_tracks(spark, folder, raw=True)
    return {r["song"]: r["failed"] for r in Q.evaluate(df, track_suite()).collect()}


def test_bounds_at_and_past_edges(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "edges.csv", [
        track_line(song="Year Low", year="1900"), track_line(song="Year Under", year="1899"),
        track_line(song="Year High", year="2023"), track_line(song="Year Over", year="2024"),
        track_line(song="Pop Top", pop="100"), track_line(song="Pop Over", pop="101"),
        track_line(song="Tempo Zero", tempo="0.0"), track_line(song="Tempo Neg", tempo="-0.001"),
        track_line(song="Tempo Max", tempo="300"), track_line(song="Tempo Over", tempo="300.5"),
    ])
    f = _failed(spark, tmpdir_fresh)
    for ok in ("Year Low", "Year High", "Pop Top", "Tempo Zero", "Tempo Max"):
        assert f[ok] == [], ok
    assert f["Year Under"] == ["between(year)"] and f["Year Over"] == ["between(year)"]
    assert f["Pop Over"] == ["between(popularity)"]
    assert f["Tempo Neg"] == ["between(tempo)"] and f["Tempo Over"] == ["between(tempo)"]


def test_text_in_numbers_nan_and_nulls(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "dirty.csv", [
        track_line(song="Text Duration", duration="abc"),
        track_line(song="Text Year", year="20x0"),
        track_line(song="Nan Year", year="NaN"),
        track_line(song="Float Duration", duration="200000.5"),
        track_line(artist="", song="No Artist"),
    ])
    f = _failed(spark, tmpdir_fresh)
    assert f["Text Duration"] == ["of_type(duration_ms)", "not_match(duration_ms)"]
    assert f["Text Year"] == ["between(year)", "not_match(year)"]
    assert f["Nan Year"] == []                     # a missing token is null, and null passes
    assert f["Float Duration"] == ["of_type(duration_ms)"]
    assert f["No Artist"] == ["not_null(artist)"]  # empty field reads as missing


def test_stats_and_alert_for_mixed_file(spark, tmpdir_fresh):
    write_csv(tmpdir_fresh, "mixed.csv", [track_line(song=f"S{i}") for i in range(47)]
              + [track_line(song=f"B{i}", year="2024") for i in range(3)])
    write_csv(tmpdir_fresh, "header_only.csv", [])
    df = FS.scan_tracks(spark, tmpdir_fresh, raw=True)
    suite = track_suite()
    st = Q.file_stats(df, suite, "file_name")
    files = FS.discover_files(spark, tmpdir_fresh).select(F.col("filename").alias("file_name"))
    full = Q.file_outcomes(files, st, "file_name")
    out = {r["file_name"]: r for r in full.collect()}
    assert (out["mixed.csv"]["valid_rows"], out["mixed.csv"]["invalid_rows"]) == (47, 3)
    assert out["header_only.csv"]["outcome"] == "empty_file"
    al = {r["file_name"]: r for r in Q.alerts(full, "file_name").collect()}
    assert al["mixed.csv"]["error_ratio_text"] == "6.00%" and al["mixed.csv"]["severity"] == "LOW"
    assert "header_only.csv" in al
    counts = st.collect()[0]["error_counts"]
    assert counts["out_of_range"] == 1 and counts["missing_values"] == 0
