import collections
import re

import numpy as np
import pytest

from cadenza.llm import quality_rules as q
from cadenza.llm.text_statistics import NAMES, with_statistics
from cadenza.tables import table
from tests.llm.frames import as_set, awkward, empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    three = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_chars": len(text), "n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "n_distinct_words": len(set(w)), "n_upper": len(re.findall("[A-Z]", text)),
            "n_digits": len(re.findall("[0-9]", text)), "n_stops": len(re.findall("[.!?]", text)),
            "longest_word": max(map(len, w), default=0)}


def test_statistics_by_brute_force(spark):
    rows = awkward() + [(200 + i, t, "en", "s", 1) for i, t in enumerate(
        ["a\n\na\n a\n\t\n", "x y x y x y", "no-break is one word", "a b c a b", "﻿é\U0001f600 \x1c"])]
    got = with_statistics(frame(spark, rows), ["doc_id", "text"], NAMES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {n: r[n] for n in NAMES} == plain_counts(r["text"]), repr(r["text"])[:60]


def test_chi_square():
    assert q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert q.chi2_cdf(7.0, 7) == pytest.approx(0.5711, abs=1e-3)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        n = int(np.exp(rng.normal(5, 0.4))) + 50
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n)]
        if i % 45 == 0:  # planted outliers
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words), "en", "hot" if i % 3 else "small", 1))
    return rows


def test_outliers_go_and_clean_texts_stay(spark, corpus):
    got = {r.doc_id: r for r in q.judge(frame(spark, corpus)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {i for i in got if i % 45 == 0}


def test_estimate_is_near_the_clean_rows(spark, corpus):
    """The distance equals that of the plain estimate on the nearest rows."""
    rows = [r for r in corpus if r[3] == "hot"]
    out = q.judge(frame(spark, rows))
    x = out.select("doc_id", "distance", *[c.alias(n) for n, c in zip(q.X, q.vector())]).toPandas()
    v = x[q.X].to_numpy()
    near = x["distance"].to_numpy() <= np.quantile(x["distance"], q.SUPPORT)
    mu = v[near].mean(0)
    c = np.cov(v[near].T, bias=True) * q.CONSISTENCY + np.diag(np.square(q.FLOORS))
    d = np.einsum("ij,jk,ik->i", v - mu, np.linalg.inv(c), v - mu)
    assert np.quantile(np.abs(d - x["distance"]) / (1 + d), 0.9) < 0.1


def test_shuffled_estimates_agree(spark, corpus, monkeypatch):
    cols = ["doc_id", "base_failed", "kept"]
    want = as_set(q.judge(frame(spark, corpus)).select(cols))
    monkeypatch.setattr(q, "BROADCAST_GROUPS", -1)
    assert as_set(q.judge(frame(spark, corpus)).select(cols)) == want


def test_awkward_and_empty(spark):
    rows = awkward()
    got = q.judge(frame(spark)).collect()
    assert len(got) == len(rows)
    for r, text in zip(sorted(got, key=lambda r: str(r.doc_id)), [x[1] for x in sorted(rows, key=lambda r: str(r[0]))]):
        assert r.kept == (not r.base_failed)  # too few rows for an estimate
    failed = sum((c["n_words"] < 50) or 100 * c["n_repeat_words"] > 50 * c["n_words"]
                 for c in (plain_counts(r[1]) for r in rows))
    assert sum(r.base_failed for r in got) == failed
    assert q.judge(empty(spark)).count() == 0


def test_distances_settle_for_every_language_and_source(spark):
    """On the given documents: each group with rows enough has an estimate
    of its own, and it is where one more step, by plain numpy, leaves it;
    no text labelled good is rejected."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = q.judge(docs).withColumns({f"x{i}": c for i, c in enumerate(q.vector())}).toPandas()
    fit = out[~out.base_failed]
    own = 0
    limit = q.chi2_quantile(1 - q.TAIL, q.DIM)
    for _, g in fit.groupby(["lang", "source"], dropna=False):
        if len(g) < q.LEAST_ROWS:
            continue
        own += len(g)
        x, d = g[q.X].to_numpy(float), g.distance.to_numpy(float)
        cut = np.sort(d)[int(np.ceil(q.SUPPORT * len(d))) - 1]
        half = x[d <= cut]
        mu = half.mean(0)
        c = q.CONSISTENCY * (half.T @ half / len(half) - np.outer(mu, mu)) + np.diag(np.square(q.FLOORS))
        again = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(c), x - mu)
        assert np.allclose(d, again, rtol=1e-3, atol=1e-6)
        assert (g.kept.to_numpy() == (again <= limit)).all()
    assert own > 0.5 * len(fit)
    good = fit.merge(labels.toPandas(), on="doc_id")
    assert good[good.quality == 1].kept.all()
