import datetime as dt

import pytest

from cadenza.functions import columns as C
from cadenza.functions import predicates as P


def test_na_tokens_and_to_numeric(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("n/a",), ("abc",), ("",), (" 2 ",)], "v string")
    got = [r[0] for r in df.select(C.to_numeric("v")).collect()]
    assert got[0] == 1.5 and got[1] is None and got[2] is None and got[3] is None and got[4] is None
    assert got[5] == 2.0


def test_cast_or_drop_truncates_ints_and_splits(spark):
    df = spark.createDataFrame([("a", "3.7", "0.5"), ("b", "x", "0.1"), ("c", "4", None), ("d", "5", "NaN")],
                               "id string, n string, d string")
    kept, dropped = C.cast_or_drop(df, {"n": "int", "d": "double"})
    assert [(r["id"], r["n"]) for r in kept.collect()] == [("a", 3)]
    assert sorted(r["id"] for r in dropped.collect()) == ["b", "c", "d"]


def test_fill_replaces_null_and_nan(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), "x")], "x double, g string")
    got = C.fill(df, {"x": 0.0, "g": "Unknown"}).collect()
    assert [(r["x"], r["g"]) for r in got] == [(0.0, "Unknown"), (0.0, "x")]


def test_drop_incomplete_drops_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, g string")
    assert C.drop_incomplete(df, ["x", "g"]).count() == 1


def test_letters_only_modes(spark):
    df = spark.createDataFrame([("Hello World",), ("Élan",), ("Song_4",), ("   ",), (None,)], "s string")
    got = df.select(C.letters_only("s", True).alias("u"), C.letters_only("s", False).alias("a")).collect()
    assert [r["u"] for r in got] == [True, True, False, False, False]
    assert [r["a"] for r in got] == [True, False, False, True, False]


def test_contains_literal_vs_regex(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), (None,)], "s string")
    assert df.filter(P.contains_ci("s", "A.B")).count() == 1
    assert df.filter(P.contains_ci("s", "a.b", regex=True)).count() == 2


def test_category_and_source_bypass(spark):
    df = spark.createDataFrame([("Pop, Rock", "WEBAPP"), ("jazz", "SCHEDULED")], "g string, src string")
    assert P.category(df, "g", "ALL").count() == 2
    assert P.category(df, "g", "rock").count() == 1
    assert P.source_is(df, "src", "all").count() == 2
    assert P.source_is(df, "src", "WEBAPP").count() == 1


def test_date_modes(spark):
    ts = [dt.datetime(2024, 1, 10, 0, 0), dt.datetime(2024, 1, 10, 12, 0), dt.datetime(2024, 1, 11, 0, 0),
          dt.datetime(2024, 1, 11, 0, 0, 1), dt.datetime(2024, 1, 5, 0, 0)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp")
    n = lambda mode: df.filter(P.between_days("ts", "2024-01-05", "2024-01-10", mode)).count()
    assert n("next_midnight") == 4   # includes the next midnight itself
    assert n("midnight") == 2        # end day after 00:00 is lost
    assert n("date") == 3            # calendar dates inclusive


def test_page_checks():
    with pytest.raises(ValueError):
        P.check_page(0, 0)
    with pytest.raises(ValueError):
        P.check_page(101, 0)
    with pytest.raises(ValueError):
        P.check_page(10, -1)


def test_parse_day_and_template(spark):
    df = spark.createDataFrame([("2024-01-05", "pop", 0.5, 120.0), ("bad", "rock", 0.1, 90.5)],
                               "d string, g string, x double, t double")
    got = df.select(C.parse_day("d").alias("p"), C.describe_row("g", "x", "t").alias("s")).collect()
    assert got[0]["p"] == dt.datetime(2024, 1, 5) and got[1]["p"] is None
    assert got[0]["s"] == "Predicted for pop with 0.5 danceability and 120.0 tempo"


def test_json_roundtrip(spark):
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    j = df.select(C.to_json_col("id", "s").alias("j"))
    back = j.select(C.from_json_col("j", "id long, s string").alias("r")).collect()[0]["r"]
    assert back["id"] == 1 and back["s"] == "a"
