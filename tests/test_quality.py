from pyspark.sql import functions as F

from cadenza.operators import quality as Q
from cadenza.operators.quality import Expectation as E
from cadenza.schema import track_suite


def _rows(spark, data, cols):
    return spark.createDataFrame(data, cols)


def test_rules_null_passes_and_bounds_inclusive(spark):
    df = _rows(spark, [("a", "1900"), ("b", "2023"), ("c", "1899"), ("d", "2024"), ("e", None),
                       (None, "abc"), ("f", "20x3")], "artist string, year string")
    suite = [E("not_null", "artist"), E("between", "year", (1900, 2023)),
             E("not_match", "year", ("[a-zA-Z]",))]
    got = {r["artist"]: r["failed"] for r in Q.evaluate(df, suite).collect()}
    assert got["a"] == [] and got["b"] == [] and got["e"] == []
    assert got["c"] == ["between(year)"] and got["d"] == ["between(year)"]
    assert got["f"] == ["between(year)", "not_match(year)"]
    assert got[None] == ["not_null(artist)", "between(year)", "not_match(year)"]


def test_type_rule_on_text(spark):
    df = _rows(spark, [("1",), ("12",), ("3.5",), ("x",), (None,)], "v string")
    got = [r["failed"] for r in Q.evaluate(df, [E("of_type", "v", ("int",))]).orderBy("v").collect()]
    assert [len(x) for x in got] == [0, 0, 0, 1, 1]  # null, 1, 12 pass; 3.5 and x fail


def test_file_stats_valid_plus_invalid_is_total(spark):
    df = _rows(spark, [("f1", 1.0), ("f1", 5.0), ("f2", 0.5), ("f3", 9.0)], "file string, x double")
    suite = [E("between", "x", (0.0, 1.0))]
    st = {r["file"]: r for r in Q.file_stats(Q.evaluate(df, suite), suite, "file").collect()}
    for r in st.values():
        assert r["valid_rows"] + r["invalid_rows"] == r["total_rows"]
    assert st["f1"]["out_of_range"] == 1 and st["f2"]["out_of_range"] == 0
    assert st["f1"]["error_counts"]["out_of_range"] == 1


def test_severity_thresholds_and_percent_text(spark):
    df = _rows(spark, [("a", 10, 8), ("b", 10, 7), ("c", 10, 3), ("d", 10, 4), ("e", 0, 0), ("f", 8, 1)],
               "f string, total_rows long, invalid_rows long")
    out = {r["f"]: r for r in Q.severity(df).collect()}
    assert out["a"]["severity"] == "HIGH" and out["b"]["severity"] == "MEDIUM"
    assert out["c"]["severity"] == "LOW" and out["d"]["severity"] == "MEDIUM"
    assert out["e"]["error_ratio"] == 0.0 and out["e"]["severity"] == "LOW"
    assert out["a"]["colour"] == "FF0000"
    txt = {r["f"]: r["t"] for r in df.select("f", Q.percent_text(F.col("invalid_rows"), F.col("total_rows")).alias("t")).collect()}
    assert txt["a"] == "80.00%" and txt["f"] == "12.50%" and txt["e"] == "0.00%"


def test_route_all_good_all_bad_and_split(spark):
    df = _rows(spark, [("good.csv", 0.5), ("good.csv", 0.7), ("bad.csv", 5.0), ("mix.csv", 0.2), ("mix.csv", 3.0)],
               "file string, x double")
    suite = [E("between", "x", (0.0, 1.0))]
    r = Q.route(Q.evaluate(df, suite), suite, "file").collect()
    got = sorted((x["file"], x["x"], x["route"], x["dest_name"]) for x in r)
    assert got == [("bad.csv", 5.0, "bad", "bad.csv"), ("good.csv", 0.5, "good", "good.csv"),
                   ("good.csv", 0.7, "good", "good.csv"), ("mix.csv", 0.2, "good", "valid_mix.csv"),
                   ("mix.csv", 3.0, "bad", "invalid_mix.csv")]
    # the route partition of rows is exact
    assert len(r) == df.count()


def test_track_suite_has_thirteen_rules():
    s = track_suite()
    assert len(s) == 13
    assert sum(e.kind == "between" for e in s) == 7


def test_file_outcomes_empty_file(spark):
    files = _rows(spark, [("a.csv",), ("empty.csv",)], "file string")
    df = _rows(spark, [("a.csv", 0.5)], "file string, x double")
    suite = [E("between", "x", (0.0, 1.0))]
    st = Q.file_stats(Q.evaluate(df, suite), suite, "file")
    out = {r["file"]: r["outcome"] for r in Q.file_outcomes(files, st, "file").collect()}
    assert out == {"a.csv": "ok", "empty.csv": "empty_file"}


def test_profile_histogram_counts(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c"))
    stats, hist = Q.profile(df, ["x", "c"], bins=10)
    h = {(r["feature"], r["bin"]): r["rows"] for r in hist.collect()}
    assert sum(v for (f, _), v in h.items() if f == "x") == 100
    assert h[("c", 0)] == 100 and h[("x", 9)] == 10


def test_split_by_is_an_exact_complement(spark):
    df = spark.range(50).select((F.col("id") / 10.0).alias("x"))
    suite = [E("between", "x", (0.0, 2.5))]
    valid, invalid = Q.split_by(Q.evaluate(df, suite))
    assert valid.count() + invalid.count() == 50
    assert valid.count() == 26 and invalid.filter(F.col("x") <= 2.5).count() == 0


def test_training_stats_shape(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    r = Q.training_stats(df, ["x"], bins=4).collect()[0]
    assert r["feature"] == "x" and abs(r["mean"] - 49.5) < 1e-12
    d = r["distribution"]
    assert [b["n"] for b in d] == [25, 25, 25, 25]
    assert d[0]["lo"] == 0.0 and d[-1]["hi"] == 99.0


def test_routed_rows_are_not_dealt_by_file(spark, monkeypatch):
    """Counts of few files go to the rows; of many they meet in a join."""
    df = _rows(spark, [(["a", "b", "c", None][i % 4], float(i % 8)) for i in range(80)], "file string, x double")
    suite = [E("between", "x", (0.0, 3.0))]
    monkeypatch.setattr(Q, "SENT_FILES", 0)
    many = sorted(Q.route(df, suite, "file").collect(), key=str)
    monkeypatch.undo()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routed = Q.route(df, suite, "file")
        plan = routed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(routed.collect(), key=str) == many and len(many) == 80
