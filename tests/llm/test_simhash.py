import random

import numpy as np
import pytest
import xxhash

from cadenza.llm import simhash as s
from cadenza.llm.components import components
from tests.llm.frames import awkward, empty, frame


def brute_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    pairs = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(400)],
             "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == brute_components(pairs, nodes)


def plain_fingerprint(text, width):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_spark_hash(spark):
    rows = awkward()
    got = s.fingerprints(frame(spark), ["doc_id", "text"], 4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.fp % 2**64 == plain_fingerprint(r.text, 4)
    one = spark.range(1).selectExpr("xxhash64('a b c d')").first()[0]
    assert one % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def brute_links(fps):
    """Roots by all pairs."""
    u = np.unique(np.array(fps, np.uint64))
    pairs = [(int(x), int(y)) for i, x in enumerate(u) for y in u[i + 1:][np.bitwise_count(u[i + 1:] ^ x) <= 4]]
    return brute_components(pairs, [int(x) for x in u])


@pytest.mark.parametrize("block", [s.BLOCK, 5])
def test_links_by_all_pairs(spark, monkeypatch, block):
    """Random fingerprints around a few centres, with hot keys in tiles."""
    monkeypatch.setattr(s, "BLOCK", block)
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(25)] + [0, 2**64 - 1]
    fps = set()
    for _ in range(700):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            x ^= 1 << b
        fps.add(x)
    df = spark.createDataFrame([(s._signed(x),) for x in fps], "fp long").repartition(4)
    roots = {r.node % 2**64: r.root % 2**64 for r in components(s.links(df)).collect()}
    want = brute_links(list(fps))
    groups = lambda m: sorted(sorted(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps})
    assert groups(roots) == groups(want)


def test_every_pair_within_the_distance_has_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for i in range(3000):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            flips[i] |= np.uint64(1) << np.uint64(b)
    hit = np.zeros(3000, bool)
    for m, start in zip(s.MASKS, s.STARTS):
        hit |= ((flips & m) == 0) & s.near(flips, np.full(3000, start))
    assert hit.all() and len(x)


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(40)]
    rows = [(i * 7 % 1000, base[i % 40].replace("w1 ", f"x{i} ", 1).upper() if i % 5 == 0 else base[i % 40] + f" t{i}")
            for i in range(200)] + [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE")]
    df = frame(spark, [(*r, "en", "s", 1) for r in rows]).repartition(4)
    got = s.near_duplicates(df).collect()
    fp = {d: plain_fingerprint(t, 4) for d, t in rows}
    root = brute_links(list(fp.values()))
    low = {}
    for d, x in fp.items():
        low[root[x]] = min(low.get(root[x], d), d)
    assert {r.doc_id: r.component_id for r in got} == {d: low[root[x]] for d, x in fp.items()}
    assert {r.doc_id: r.fp % 2**64 for r in got} == fp
    kept = s.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())


def test_awkward_and_empty(spark):
    rows = awkward()
    got = s.near_duplicates(frame(spark), keep=["doc_id", "n_chars"]).collect()
    assert len(got) == len(rows)
    blank = {r.component_id for r in got if r.fp == 0}
    assert blank == {100}
    # components may share their smallest id, never their root
    rooted = s.near_duplicates(frame(spark), root_col="r").collect()
    assert len(s.keep_one(frame(spark)).collect()) == len({r.r for r in rooted})
    assert s.near_duplicates(empty(spark)).count() == 0 and s.keep_one(empty(spark)).count() == 0
    nulls = frame(spark, [(None, "a b c d e", None, None, None), (None, "a b c d e", None, None, None)])
    assert [r.component_id for r in s.near_duplicates(nulls).collect()] == [None, None]
    assert s.keep_one(nulls).count() == 1


def test_keep_one_of_every_component_whatever_its_ids(spark):
    """Two texts under one id are two components; null-id near copies with
    different fingerprints are one."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(rng.choices(words, k=200)) for _ in range(3))
    near = next(t for i in range(200) for t in [c + f" t{i}"] if 0 < (
        plain_fingerprint(t, 4) ^ plain_fingerprint(c, 4)).bit_count() <= 4)
    rows = [(7, a), (7, b), (8, a), (9, b), (None, c), (None, near), (None, c)]
    kept = [(r.doc_id, r.text) for r in s.keep_one(frame(spark, [(*r, "en", "s", 1) for r in rows])).collect()]
    assert sorted(r for r in kept if r[0] is not None) == sorted([(7, a), (7, b)])
    assert len(kept) == 3 and {t for d, t in kept if d is None} < {c, near}


def test_groups_grow_with_the_rows(spark, monkeypatch):
    """Rows of a group stay near the bound at two sizes."""
    monkeypatch.setattr(s, "GROUP_ROWS", 400)
    rng = random.Random(8)
    most = []
    for n in (2_000, 10_000):
        fps = spark.createDataFrame([(s._signed(rng.getrandbits(64)),) for _ in range(n)], "fp long").repartition(4)

        def counted(table):
            import pyarrow as pa
            return pa.table({"a": pa.array([table.num_rows], pa.int64()), "b": pa.array([0], pa.int64())})

        with monkeypatch.context() as m:
            m.setattr(s, "_links", counted)
            seen = [r.a for r in s.links(fps).collect()]
        assert sum(seen) == n * len(s.MASKS)
        most.append(max(seen))
    assert max(most) <= 2 * 400 and s.group_count(10**9, spark) == 10**9 // 400
