"""Toxicity and the rule ensemble: held-out accuracy and defined results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import labels as lb
from cadenza.llm import rule_ensemble, toxicity
from tests.conftest import SF_SMALL
from tests.llm.frames import awkward, empty, frame

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    """Clean and rude texts; junk is of low quality; a tenth of labels is null."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rude = ["grobian", "grobianer", "schuft", "nitwit"]
    rows, labels = [], []
    for i in range(1200):
        w = rng.choices(words, k=rng.randint(30, 200))
        toxic, junk = i % 7 == 0, i % 5 == 1
        if toxic:
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(len(w))] = rng.choice(rude)
        if junk:
            w = [x.upper() + "$$" for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        if i % 2 == 0 or toxic:
            labels.append((i, int(not junk), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (labels[0][0], None, None)]
    return frame(spark, rows).repartition(4), spark.createDataFrame(labels, LABELS)


def test_sample_is_bounded_and_repeats(spark, corpus):
    _, labels = corpus
    a = lb.sample(labels.repartition(5), "toxic", 50)
    b = lb.sample(labels.repartition(2), "toxic", 50)
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r["y"]: r["count"] for r in a.groupBy("y").count().collect()} == {0: 50, 1: 50}
    total = a.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(labels.filter("doc_id is not null and toxic is not null").count())


def test_held_out_is_crc32(spark):
    import zlib
    rows = spark.range(200).select(F.col("id").alias("doc_id"), lb.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxic_texts_are_found(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    assert {r.doc_id for r in got if r.toxic} == set(range(0, 1200, 7))
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got)
    assert (np.diff(model.thresholds) > 0).all()  # shared weights, ordered thresholds
    more = spark.createDataFrame([(1, "schuft"), (2, "schuft nitwit grobian"), (3, "plain")], "doc_id long, text string")
    one, three, none = (r.severity for r in toxicity.score(more, model, ["doc_id"]).orderBy("doc_id").collect())
    assert none < one < three
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 1200 - len(range(0, 1200, 7))


def test_toxicity_gradient():
    """The fit reaches a minimum: no small step lowers the loss."""
    rng = np.random.default_rng(0)
    n, f = 300, 6
    x = rng.poisson(0.5, (n, f)).astype(float)
    y = np.clip(np.digitize(x @ np.array([2, 1, 0, 0, -1, 1.5]) + rng.logistic(size=n), [1, 3, 5]), 0, 3)
    row, col = np.nonzero(x)
    w, t = toxicity._fit(row, col, x[row, col], f, y, np.ones(n))

    def loss(w, t):
        s = 1 / (1 + np.exp(-np.clip(np.r_[-50, t, 50][None] - (x @ w)[:, None], -50, 50)))
        p = s[np.arange(n), y + 1] - s[np.arange(n), y]
        return -np.log(p.clip(1e-12)).sum() + toxicity.RIDGE / 2 * w @ w
    best = loss(w, t)
    for i in range(f + 3):
        for d in (-0.05, 0.05):
            step = np.zeros(f + 3)
            step[i] = d
            assert loss(w + step[:f], t + step[f:]) > best - 1e-2


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    model = rule_ensemble.fit(docs, labels)
    got = rule_ensemble.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1200 and len(held) > 150
    assert all(r.predicted == int(r.doc_id % 5 != 1) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    again = rule_ensemble.fit(docs.repartition(7), labels)
    assert again == model


def test_rules_are_what_the_columns_say(spark):
    rule = rule_ensemble.simplified((("upper", True, 0.5), ("upper", True, 0.2), ("symbols", False, 0.1)))
    assert rule == (("symbols", False, 0.1), ("upper", True, 0.2))
    df = spark.createDataFrame([(0.2, 0.11), (0.3, 0.5), (0.1, 0.1)], "upper double, symbols double")
    assert [r[0] for r in df.select(rule_ensemble.condition(rule)).collect()] == [True, False, False]


def test_awkward_and_empty(spark, corpus):
    docs, labels = corpus
    none = spark.createDataFrame([], LABELS)
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    for lab in (none, one_class):
        assert not any(r.toxic for r in toxicity.score(frame(spark), toxicity.fit(frame(spark), lab), ["doc_id"]).collect())
        got = rule_ensemble.score(frame(spark), rule_ensemble.fit(frame(spark), lab)).collect()
        assert len({r.score for r in got}) == 1
    tox, qual = toxicity.fit(docs, labels), rule_ensemble.fit(docs, labels)
    n = len(awkward())
    assert toxicity.score(frame(spark), tox, ["doc_id", "text"]).count() == n
    got = rule_ensemble.score(frame(spark), qual).collect()
    assert len(got) == n and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty(spark), tox, ["doc_id"]).count() == 0
    assert rule_ensemble.score(empty(spark), qual).count() == 0
    assert toxicity.fit(empty(spark), none).weights.size == 0


def test_given_tables(spark):
    """Held-out quality on the smallest given tables."""
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = rule_ensemble.score(docs, rule_ensemble.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.85 * len(got)
