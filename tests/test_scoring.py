from pyspark.sql import functions as F

from cadenza.operators import scoring as SC


def test_linear_score_and_regression_line(spark):
    df = spark.createDataFrame([(1.0, 3.0, "a"), (2.0, 5.0, "b"), (3.0, 7.0, "a")], "x double, y double, g string")
    s = df.select(SC.linear_score({"x": 2.0}, 1.0, ("g", {"a": 10.0})).alias("p")).collect()
    assert [r["p"] for r in s] == [13.0, 5.0, 17.0]
    r = SC.regression_line(df, "x", "y").collect()[0]
    assert abs(r["slope"] - 2.0) < 1e-12 and abs(r["intercept"] - 1.0) < 1e-12 and r["n_rows"] == 3


def test_train_and_score_rows_skip_bad(spark):
    train = spark.createDataFrame(
        [(200000 + i, 1990 + i % 30, 0.5, -5.0, "pop" if i % 2 else "rock", float(i % 100)) for i in range(200)],
        "duration_ms int, year int, energy double, loudness double, genre string, popularity double")
    model = SC.train(train, ["duration_ms", "year", "energy", "loudness", "genre"], "popularity",
                     categorical=["genre"])
    raw = spark.createDataFrame([("Good Song", "200000", "2001", "0.5", "-5.0", "pop"),
                                 ("Song_4", "200000", "2001", "0.5", "-5.0", "pop"),
                                 ("Other", "abc", "2001", "0.5", "-5.0", "jazz")],
                                "song string, duration_ms string, year string, energy string, loudness string, genre string")
    scored, skipped = SC.score_rows(raw, model, {"duration_ms": "int", "year": "int", "energy": "double",
                                                 "loudness": "double"}, name_col="song")
    assert [r["song"] for r in scored.collect()] == ["Good Song"]
    assert skipped.count() == 2
    assert scored.filter(F.col("predicted").isNull()).count() == 0


def test_batch_result_bounded_and_ordered(spark):
    df = spark.createDataFrame([("f", i, float(i)) for i in range(25)], "f string, k long, s double")
    b = SC.batch_result(df, "f", ["k"], "k", "s", batch_size=10).orderBy("batch_no").collect()
    assert [r["n_rows"] for r in b] == [10, 10, 5]
    assert b[1]["payload"]["songs"] == list(range(10, 20)) and b[2]["mean_score"] == 22.0
