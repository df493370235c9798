"""Mergeable summaries: sketches, drift, frequent values, kept totals, new
keys, and the text index."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.operators import distributions as D
from cadenza.operators import frequent as FR
from cadenza.operators import novelty as N
from cadenza.operators import running as R
from cadenza.operators import text_index as TI
from cadenza.operators.quality import Expectation


@pytest.mark.parametrize("n", [3_000, 60_000])
def test_merged_sketches_stay_within_their_error(spark, n):
    """Many files and days, one file in a third of all rows; nulls and NaN
    are no values."""
    df = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 40).cast("string"))).alias("file"),
        (F.col("id") % 7).alias("day"), F.exp(F.randn(3)).alias("x"),
        F.when(F.col("id") % 10 == 0, float("nan")).when(F.col("id") % 11 > 0, F.rand(4)).alias("y"))
    df = df.cache()
    stored = D.sketches(df, ["file", "day"], ["x", "y"]).cache()
    assert stored.select("file", "day").distinct().count() > 100
    shares = [0.01, 0.1, 0.5, 0.9, 0.99]
    for r in D.quantiles(D.merge(stored, []), shares).collect():
        values = df.filter(F.col(r["feature"]).isNotNull() & ~F.isnan(r["feature"]))
        total = values.count()
        below = values.filter(F.col(r["feature"]) <= r["quantile"]).count()
        assert r["n_rows"] == total and abs(below / total - r["share"]) <= D.rank_error() + 2 / total
    df.unpersist()
    stored.unpersist()


def test_drift_by_hand(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(4000)]
    groups = {"same": [rng.gauss(0, 1) for _ in range(3000)], "moved": [rng.gauss(1, 1) for _ in range(3000)],
              "one": [9.0] * 50}
    train = spark.createDataFrame([(v,) for v in [*base, None, float("nan")]], "v double")
    late = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(None, 0.0)], "g string, v double")
    edges = D.training_edges(train, ["v"])
    cuts = edges.first()["edges"]
    order = sorted(base)
    assert cuts == [order[math.ceil(len(order) * i / 10) - 1] for i in range(1, 10)]

    def shares(values):
        n = Counter(sum(c < v for c in cuts) for v in values)
        return [n[b] / len(values) for b in range(len(cuts) + 1)]

    counts = D.bin_counts(late, ["g"], ["v"], edges)
    got = {r["g"]: r for r in D.drift(counts, D.bin_counts(train, [], ["v"], edges), ["g"], edges).collect()}
    q = shares(base)
    for g, values in [*groups.items(), (None, [0.0])]:
        p = shares(values)
        psi = sum((max(a, D.LEAST_SHARE) - max(b, D.LEAST_SHARE)) * math.log(max(a, D.LEAST_SHARE) / max(b, D.LEAST_SHARE))
                  for a, b in zip(p, q))
        run, most = 0.0, 0.0
        for a, b in zip(p, q):
            run += a - b
            most = max(most, abs(run))
        assert got[g]["psi"] == pytest.approx(psi) and got[g]["distance"] == pytest.approx(most)
        assert got[g]["n_rows"] == len(values)
    assert got["same"]["psi"] < 0.05 < 0.2 < got["moved"]["psi"]
    # the sketches see the same distances
    merged = D.merge(D.sketches(late, ["g"], ["v"]), ["g"])
    near = D.drift(D.sketch_counts(merged, ["g"], edges), D.bin_counts(train, [], ["v"], edges), ["g"], edges)
    for r in near.collect():
        assert abs(r["distance"] - got[r["g"]]["distance"]) <= D.rank_error() + 1 / r["n_rows"]


SUITE = [Expectation("between", "v", (0, 100)), Expectation("not_null", "v"), Expectation("not_match", "s", ("^x",))]


def brute_frequent(rows, k):
    broken = Counter()
    for f, v, s in rows:
        if v is None:
            broken[f, "not_null(v)", None] += 1
        elif not 0 <= v <= 100:
            broken[f, "between(v)", str(v)] += 1
        if s is not None and s.startswith("x"):
            broken[f, "not_match(s)", s] += 1
    out = set()
    for group in {key[:2] for key in broken}:
        best = sorted(((n, v) for (*g, v), n in broken.items() if tuple(g) == group),
                      key=lambda x: (-x[0], x[1] is None, x[1] or ""))
        out |= {(*group, i + 1, v, n) for i, (n, v) in enumerate(best[:k])}
    return out


@pytest.mark.parametrize("counters", [FR.COUNTERS, 4])
def test_frequent_values_by_counting(spark, counters):
    """A hot value in a third of all rows, a long tail of rare values (where
    the summaries alone cannot decide), nulls in every column."""
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([777, 777, 50, None, -1 - int(rng.expovariate(0.02))]),
             rng.choice([None, "ok", "x1", f"x{rng.randint(0, 3000)}"])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "f string, v int, s string").repartition(5)
    got = {tuple(r) for r in FR.frequent_values(df, SUITE, "f", 5, counters).collect()}
    assert got == brute_frequent(rows, 5)


def test_summaries_are_bounded_and_lose_no_more_than_they_say(spark):
    rng = random.Random(1)
    rows = [("a", int(-1 - rng.paretovariate(0.6)), None) for _ in range(5000)]
    long = FR.offending_values(spark.createDataFrame(rows, "f string, v int, s string").repartition(3), SUITE, ["f"])
    parts = FR.summaries(long, ["f"], 8).collect()
    true = Counter(str(v) for _, v, _ in rows)
    lost = sum(r["loss"] for r in parts)
    low = Counter()
    for r in parts:
        if not r["mark"]:
            low[r["value"]] += r["n"]
    assert len([r for r in parts if not r["mark"]]) <= 3 * 8
    assert all(low[v] <= n <= low[v] + lost for v, n in true.items())
    assert lost <= 5000 / 9 + 3  # at most the rows over one more than the counters
    assert FR.frequent_values(spark.createDataFrame([], "f string, v int, s string"), SUITE, "f").count() == 0


def test_kept_totals_equal_a_recomputation(spark, tmpdir_fresh):
    """Three arrivals and a changed file; only new and changed files are
    read, and a commit made twice counts once."""
    files = {"a": [(1, 2.0), (2, None), (1, -4.0)], "b": [(1, 1.0)], "c": [(3, 8.0), (3, 9.0)]}
    fingerprints = {"a": "1", "b": "1", "c": "1"}
    version = 0

    def arrive(*names, again=False):
        nonlocal version
        listing = spark.createDataFrame([(n, fingerprints[n]) for n in names], "filename string, fingerprint string")
        todo = R.pending(spark, tmpdir_fresh, listing)
        read = sorted(r["filename"] for r in todo.collect())
        rows = spark.createDataFrame([(n, g, v) for n in read for g, v in files[n]], "f string, g int, v double")
        todo = spark.createDataFrame([(n, fingerprints[n]) for n in read], "filename string, fingerprint string")
        for _ in range(2 if again else 1):
            R.take(spark, tmpdir_fresh, todo, rows, "f", ["g"], "v", version)
        version += 1
        return read

    def same():
        want = {}
        for rows in files.values():
            for g, v in rows:
                want.setdefault(g, []).append(v)
        got = {r["g"]: r for r in R.summary(spark, tmpdir_fresh, ["g"]).collect()}
        assert set(got) == set(want)
        for g, vs in want.items():
            known = [v for v in vs if v is not None]
            r = got[g]
            assert (r["n_rows"], r["n_values"]) == (len(vs), len(known))
            assert (r["total"], r["least"], r["greatest"]) == (
                (sum(known), min(known), max(known)) if known else (None, None, None))

    with pytest.raises(ValueError):
        R.summary(spark, tmpdir_fresh, ["g"])
    assert arrive("a") == ["a"]
    assert arrive("a", "b", again=True) == ["b"]
    assert arrive("a", "b", "c") == ["c"]
    same()
    files["a"], fingerprints["a"] = [(2, 5.0)], "2"  # group 1 of this file is gone
    assert arrive("a", "b", "c") == ["a"]
    same()


@pytest.mark.parametrize("n", [500, 30_000])
def test_new_keys_within_the_bound(spark, n):
    """Small sketches, so that the larger size is estimated; keys of two
    columns with nulls."""
    size = 10
    key = [F.when(F.col("id") % 50 > 0, F.col("id") % 977).alias("a"), (F.col("id") % 1009).cast("string").alias("b")]
    old = spark.range(n).select(F.lit("h").alias("f"), *key)
    new = spark.range(n // 2, 2 * n).select(F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("f"), *key)
    history = N.history_sketch(N.key_sketches(old, ["a", "b"], ["f"], size), size)
    told = {r["f"]: r for r in N.new_keys(N.key_sketches(new, ["a", "b"], ["f"], size), history, ["f"], size).collect()}
    seen = {(r["a"], r["b"]) for r in old.collect()}
    keys = {}
    for r in new.collect():
        keys.setdefault(r["f"], set()).add((r["a"], r["b"]))
    for f, ks in keys.items():
        exact = len(ks - seen)
        assert abs(told[f]["n_new"] - exact) <= told[f]["bound"]
        if len(ks | seen) <= 2 ** size:
            assert told[f]["bound"] == 0 and told[f]["n_new"] == exact


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    rng = random.Random(4)
    words = ["Blue", "ring", "é", "Été", "İstanbul", "a%b", "ox", "x", "ringing", "RING", "_", "\U0001f600 smile"]
    rows = [(i, None if i % 37 == 0 else " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(4)
    path = os.path.join(str(tmp_path_factory.mktemp("grams")), "p")
    TI.save_postings(df, "id", "name", path, 6)
    return rows, df, path


def test_search_equals_contains(spark, catalogue):
    rows, df, path = catalogue
    needles = ["ring", "RINGI", "é", "été", "a%b", "", "x", "ox x", "zzzz", "smile", "blue ring", "i̇st", "ring"]
    got = [(r["needle"], r["id"]) for r in TI.search(df, "id", "name", TI.open_postings(spark, path), needles).collect()]
    from cadenza.functions.predicates import contains_ci
    want = [(n, r["id"]) for n in dict.fromkeys(needles) for r in df.filter(contains_ci("name", n)).collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)


def test_search_reads_few_postings(spark, catalogue):
    """The runs reach the scan, and candidates are near the answer."""
    rows, df, path = catalogue
    stored = TI.open_postings(spark, path)
    found = TI.candidates(stored, ["ringing"])
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().executedPlan().toString()
    hits = found.count()
    assert 0 < hits <= 1.2 * sum("ringing" in (t or "").lower() for _, t in rows)
    runs = stored.filter(F.col("gram").isin(["rin", "ing", "ngi", "gin"])).count()
    assert runs < stored.count() / 2
    # runs lie together: a part of the table holds few others
    spans = stored.withColumn("part", F.input_file_name()).groupBy("gram").agg(F.countDistinct("part").alias("n"))
    assert spans.agg(F.avg("n")).first()[0] < 2
