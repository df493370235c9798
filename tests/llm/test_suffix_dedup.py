import random

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import suffix_dedup as s
from tests.llm.frames import awkward, empty, frame


def brute(rows, length):
    seen = {}
    for _, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            k = b[p:p + length]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0])).reshape(-1, 2)
        out.append((d, len(b), int(gone.sum()), [tuple(map(int, e)) for e in edge],
                    bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def run(df, length):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept))
                   for r in s.remove_repeats(df, length).collect()), key=str)


def plain_common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("depth", [5, 40, 400])
def test_suffix_array_and_common_prefixes(depth):
    rng = random.Random(depth)
    base = bytes(rng.choices(b"ab", k=300))
    parts = [base[rng.randint(0, 100):rng.randint(150, 300)] + bytes(rng.choices(b"abc", k=rng.randint(0, 40)))
             for _ in range(30)]
    text = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    left = end[np.repeat(np.arange(len(parts)), size)] - np.arange(len(text))
    order = s.suffix_array(text, left, depth)
    assert sorted(order) == list(range(len(text)))
    suffix = [bytes(text[i:i + left[i]]) for i in range(len(text))]
    heads = [suffix[i][:depth] for i in order]
    assert heads == sorted(heads)
    long = order[left[order] >= depth]
    before, shared = s.common_prefixes(text, left, long)
    for a, b in zip(long, long[1:]):
        assert before[b] == a and shared[b] == plain_common(suffix[a], suffix[b])


@pytest.mark.parametrize("hot, batch, piece", [(256 << 10, 200_000, 1 << 20), (1500, 40, 1 << 20), (256 << 10, 200_000, 100)])
def test_random_texts(spark, monkeypatch, hot, batch, piece):
    """Also with anchors dealt over shards, small batches, and cut texts."""
    monkeypatch.setattr(s, "HOT_BYTES", hot)
    monkeypatch.setattr(s, "BATCH_SEGMENTS", batch)
    monkeypatch.setattr(s, "PIECE", piece)
    rng = random.Random(5)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 120))) for _ in range(30)]
    rows = [(i, rng.choice(base)[rng.randint(0, 40):] + "".join(rng.choices("abé ", k=rng.randint(0, 30)))
             + rng.choice(base)[:rng.randint(0, 90)]) for i in range(250)]
    rows += [(900, None), (901, ""), (902, "a" * 300), (903, "ab" * 200), (5, "x" * 50), (5, "x" * 50), (None, "zz" * 40)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(5)
    assert run(df, 40) == brute(rows, 40)


def test_one_passage_in_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(s, "HOT_BYTES", 3000)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh", k=90))
    rows = [(i, "".join(rng.choices("klmnop", k=80)) + (passage if i % 3 == 0 else "")
             + "".join(rng.choices("qrstuv", k=80))) for i in range(300)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(4)
    want = brute(rows, 60)
    assert run(df, 60) == want and sum(r[2] for r in want) >= 100 * 90


@pytest.mark.parametrize("hot", [256 << 10, 3000])
def test_only_the_arrays_remove(spark, monkeypatch, hot):
    """Copies, whole and in part, stay where no shard reports them."""
    monkeypatch.setattr(s, "HOT_BYTES", hot)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh", k=200)) for _ in range(20)]
    rows = [(i, texts[i % 20] if i % 2 else texts[i % 20][:120] + "tail") for i in range(60)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(3)
    assert run(df, 60) == brute(rows, 60)
    monkeypatch.setattr(s, "_shard", lambda length, ranges: lambda table: pa.schema(
        list(zip(s._SHARD_NAMES, s._SHARD_KINDS))).empty_table())
    assert all(r[2] == 0 for r in run(df, 60))


def test_repeated_starts():
    """Two suffixes of one string, one of a copied segment, one by itself."""
    order, shared = np.array([3, 0, 1, 2]), np.array([9, 4, 2, 0])
    got = s.repeated_starts(order, shared, np.array([1, 1, 5, 1]), 5)
    assert got.tolist() == [True, False, True, True]
    assert not s.repeated_starts(order[:0], shared, np.ones(4, int), 5).any()


def test_awkward_and_empty(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert run(frame(spark), 40) == brute(rows, 40)
    assert run(empty(spark), 40) == []


def test_long_strings(spark):
    """One segment of 5,441 starts: every string holds the same anchor."""
    length, gram, width = 8000, 2560, 5441
    text = "".join(random.Random(7).choices("abcdefgh", k=100_000))
    grams = np.arange(len(text) - gram + 1)
    h = s._anchor_hash(np.frombuffer(text.encode(), np.uint8), grams, grams + gram)
    at = next(i for i in range(width, len(h) - width) if h[i] == h[i - width + 1:i + width].min())
    cut = text[at - width + 1:at + width - 1 + gram]
    rows = [(1, cut), (2, cut), (3, "x" * 100 + cut[:9000])]
    want = brute(rows, length)
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(2)
    assert run(df, length) == want and want[0][2] == len(cut)
