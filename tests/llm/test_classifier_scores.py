"""Scores of the two classifiers against plain Python, text by text."""

import collections
import math
import re

import pytest

from cadenza.llm import rule_ensemble, toxicity
from tests.conftest import SF_SMALL
from tests.llm.frames import awkward, frame
from tests.llm.test_quality_rules import plain_counts

WORD = re.compile(rb"[a-z\x80-\xff]+")
FULL = 2**64 - 1


def given(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, [(r.doc_id, r.text) for r in docs.collect()]


def plain_inputs(text):
    c = plain_counts(text)

    def per(a, b):
        return c[a] / max(c[b], 1)

    return {"log_words": math.log1p(c["n_words"]), "word_length": per("word_chars", "n_words"),
            "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"),
            "repeats": per("n_repeat_words", "n_words"), "distinct": per("n_distinct_words", "n_words"),
            "upper": per("n_upper", "n_chars"), "digits": per("n_digits", "n_chars"),
            "stops": per("n_stops", "n_words"), "longest": float(c["longest_word"]),
            "line_words": per("n_words", "n_lines")}


def plain_score(model, text):
    x = plain_inputs(text)
    total = model.intercept
    for rule, weight in model.rules:
        if all((x[name] <= value) if at_most else (x[name] > value) for name, at_most, value in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_rule_scores(spark):
    docs, labels, rows = given(spark, SF_SMALL)
    model = rule_ensemble.fit(docs, labels)
    assert model.rules
    more = [(r[0], r[1]) for r in awkward()]
    for df, texts in ((docs, rows), (frame(spark), more)):
        got = sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9), r.predicted)
                     for r in rule_ensemble.score(df, model).collect())
        want = [(d, plain_score(model, t)) for d, t in texts]
        assert got == sorted((d is None, d or 0, round(s, 9), int(s >= 0.3)) for d, s in want)


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


def plain_hash(b):
    h, power = len(b), 1
    for c in b:
        h += int(toxicity._hash.code[c]) * power
        power = power * int(toxicity._hash.base) & FULL
    return plain_mix(h & FULL)


def plain_severity(model, text, seen):
    """(expected grade, toxic) by one loop over the words."""
    known = {int(f): float(w) for f, w in zip(model.features, model.weights)}
    counts = collections.Counter()
    for b in WORD.findall((text or "").encode().lower()):
        if b not in seen:
            word = b.decode()
            seen[b] = [plain_hash(b)] + [plain_mix(plain_hash(word[:n].encode()) + n & FULL)
                                         for n in (4, 6) if len(word) > n]
        counts.update(f for f in seen[b] if f in known)
    eta = sum(known[f] * (1 + math.log(n)) for f, n in counts.items())
    above = [1 / (1 + math.exp(min(50, max(-50, t - eta)))) for t in model.thresholds]
    return sum(above), above[0] >= model.cut


def test_severities(spark):
    docs, labels, rows = given(spark, SF_SMALL.replace("sf0.001", "sf0.01"))  # the smallest has too few toxic texts
    model = toxicity.fit(docs, labels)
    assert len(model.features)
    seen = {}
    more = [(r[0], r[1]) for r in awkward()]
    for df, texts in ((docs, rows), (frame(spark), more)):
        got = sorted((r.doc_id is None, r.doc_id or 0, round(r.severity, 9), r.toxic)
                     for r in toxicity.score(df, model, ["doc_id"]).collect())
        want = ((d, *plain_severity(model, t, seen)) for d, t in texts)
        assert got == sorted((d is None, d or 0, round(s, 9), bool(x)) for d, s, x in want)
