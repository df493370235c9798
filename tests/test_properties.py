"""Property tests (hypothesis) against plain-Python definitions."""

from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import merge as M
from cadenza.operators import quality as Q
from cadenza.operators.ordinal import ordinal
from tests.test_merge import _loop_upsert

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _half_up_percent(num, den):
    if den == 0:
        return "0.00%"
    bp = Fraction(num * 10000, den) + Fraction(1, 2)
    bp = bp.numerator // bp.denominator
    return f"{bp // 100}.{bp % 100:02d}%"


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 10_000)), min_size=1, max_size=30))
def test_percent_text_is_exact_half_up(spark, pairs):
    rows = [(min(a, b), max(a, b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "num long, den long")
    got = [r[0] for r in df.select(Q.percent_text(F.col("num"), F.col("den"))).collect()]
    assert got == [_half_up_percent(a, b) for a, b in rows]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["f1", "f2", "f3"]), st.integers(0, 12)), min_size=1, max_size=120),
       st.integers(1, 7))
def test_batched_upsert_equals_row_loop(spark, rows, batch):
    data = [(f, k, i, float(i)) for i, (f, k) in enumerate(rows)]
    df = spark.createDataFrame(data, "f string, k int, o int, v double")
    got = {r["k"]: (r["f"], r["o"]) for r in M.upsert_batched(df, ["k"], "f", ["o"], batch_size=batch).collect()}
    assert got == {k: (r[0], r[2]) for k, r in _loop_upsert(data, batch).items()}


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(-5, 5)),
                min_size=1, max_size=200))
def test_ordinal_equals_row_number(spark, rows):
    data = [(g, x, i) for i, (g, x) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, x int, id int")
    got = {r["id"]: r["rn"] for r in ordinal(df, ["g"], ["x", "id"]).collect()}
    ref = {r["id"]: r["rn"] for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("g").orderBy("x", "id"))).collect()}
    assert got == ref
