import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import substring_dedup as s
from cadenza.llm.words import xxh64_of_long
from tests.llm.frames import awkward, empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """(id, words, removed, kept, spans) of every row."""
    def key(i):
        return s.NULL_ID if i is None else i

    first = {}
    for d, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            first[k] = min(first.get(k, s.NULL_ID), key(d))
    out = []
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < key(d):
                gone[i:i + width] = [True] * width
        edge = np.flatnonzero(np.diff(np.r_[0, np.array(gone, int), 0]))
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g),
                    [tuple(map(int, e)) for e in edge.reshape(-1, 2)]))
    return sorted(out, key=str)


def run(df, width):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(x) for x in r.removed])
                   for r in s.remove_repeats(df, width).collect()), key=str)


def test_bucket_hash_equals_sparks(spark):
    ids = np.array([0, 1, -1, 2**62, s.NULL_ID, -2**63, 12345], np.int64)
    want = [r[0] for r in spark.createDataFrame([(int(i),) for i in ids], "i long").selectExpr("xxhash64(i)").collect()]
    assert xxh64_of_long(ids).view(np.int64).tolist() == want


@pytest.mark.parametrize("batch", [s.BATCH_WINDOWS, 50])
def test_random_texts(spark, monkeypatch, batch):
    monkeypatch.setattr(s, "BATCH_WINDOWS", batch)
    rng = random.Random(4)
    base = [[rng.choice("ab é\t".split() + ["c", "dd"]) for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(rng.choice(base)[rng.randint(0, 20):] + [str(rng.randint(0, 9))] + rng.choice(base)[:rng.randint(0, 30)]))
            for i in rng.sample(range(10_000), 300)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(5)
    assert run(df, 5) == brute(rows, 5)


def test_one_passage_in_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(s, "BATCH_WINDOWS", 200)
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"u{i} " + (passage if i % 3 == 0 else f"v{i}") + f" w{i}") for i in range(600)]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(6)
    assert run(df, 13) == brute(rows, 13)


def test_awkward_and_empty(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert run(frame(spark), 13) == brute(rows, 13)
    assert run(empty(spark), 13) == []


def test_windows_of_one_hash_are_told_by_their_part(monkeypatch):
    """With a first hash of the last word only, different windows collide."""
    monkeypatch.setattr(s, "_MULTIPLIER", np.uint64(0))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b z", "c d z", "a b z"])], ["id", "text"])
    out = pa.Table.from_batches(s._send(3, 1 << 20, 8)([batch])).to_pylist()
    flagged = [i for r in out if r["bucket"] >= 0 for i in np.frombuffer(r["docs"], np.int64)]
    assert flagged == [3]
    sent = {r["part"] for r in out if r["bucket"] < 0}
    assert len(sent) == 2
