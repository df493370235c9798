import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cadenza.llm import token_alignment as ta
from cadenza.tables import table
from tests.conftest import SF_SMALL
from tests.llm.frames import awkward, empty, frame

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    with open(A_FILE, "rb") as a, open(B_FILE, "rb") as b:
        return ta.Tokenizers(a.read(), b.read())


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_FILE)


def brute_groups(text, known, plain):
    """Groups by walking over both whole encodings."""
    if not text:
        return []
    a, b = plain[0].encode(" " + text, add_special_tokens=False).ids, plain[1].encode(text)
    raw = (" " + text).encode()
    if b"".join(known.a_bytes[i] for i in a) != raw or b"".join(known.b_bytes[i] for i in b) != raw:
        return []
    ends_a = np.cumsum([len(known.a_bytes[i]) for i in a]).tolist()
    ends_b = np.cumsum([len(known.b_bytes[i]) for i in b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_i, to_j = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        out.append((a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    assert (i, j) == (len(a), len(b))
    return out


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(rows, known, plain):
    """The whole result by plain loops."""
    per, hold = [], Counter()
    for doc_id, text in rows:
        groups = brute_groups(text, known, plain)
        links = Counter((i, j) for a, b in groups for i in a for j in b)
        hold.update(links.keys())
        per.append((doc_id, groups, links))
    top = defaultdict(int)
    for (i, _), n in hold.items():
        top[i] = max(top[i], n)
    return [(d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
             sum(c for k, c in links.items() if hold[k] == top[k[0]]), sum(c * hold[k] for k, c in links.items()),
             sha256(written(g).encode()).hexdigest() if g else "") for d, g, links in per]


def test_units_are_encoded_as_whole_texts(known, plain):
    """White space of every kind, special strings, and random characters."""
    space = [*ta._SPACE, *ta._UNSURE, "​", "᠎", "\x00"]
    texts = [f"a!{x}{y}b {x}c{y}" for x in space for y in space]
    texts += ["<|endoftext|> a <s> </s><unk> <0x41>", "▁x", "a▁b c", "it's  don't", "日本語 テキスト", "\U0001f600\U0001f600 ok",
              "x" * 5000, "  ", " \n\n ", None, "", " " * 3000, "12345" * 99]
    rng = random.Random(1)
    letters = [*map(chr, range(32, 127)), "\n", "\t", "\r", "\xa0", "é", "一", "\U0001f600", "̀"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(1500)]
    got = ta.Aligned(known, texts).groups
    assert got == [written(brute_groups(t, known, plain)) for t in texts]


def test_overlaps_are_the_union_of_both_directions():
    rng = random.Random(4)
    rows = {"a": [], "b": []}
    base = 0
    for doc in range(30):
        size = rng.randint(1, 60)
        for side in rows:
            cuts = sorted({0, size, *rng.sample(range(size + 1), rng.randint(0, size))})
            rows[side] += [(doc, base + x, base + y) for x, y in zip(cuts, cuts[1:])]
        base += size
    a, b = (pd.DataFrame(rows[s], columns=["doc", "start", "end"]) for s in "ab")
    got = sorted(ta.overlaps(a, b)[["ia", "ib"]].itertuples(index=False, name=None))
    want = sorted((i, j) for i, x in enumerate(rows["a"]) for j, y in enumerate(rows["b"])
                  if max(x[1], y[1]) < min(x[2], y[2]))
    assert got == want


@pytest.mark.parametrize("many", [ta.MANY_LINKS, 2])
def test_links_of_large_groups_are_counted_first(known, plain, monkeypatch, many):
    monkeypatch.setattr(ta, "MANY_LINKS", many)
    text = "unalignable wordings, überhaupt 日本 " * 9
    x = ta.Aligned(known, [text, None, text[5:]])
    for doc, t in ((0, text), (2, text[5:])):
        links = Counter((i, j) for a, b in brute_groups(t, known, plain) for i in a for j in b)
        own = x.doc == doc
        assert dict(zip(x.pair[own].tolist(), x.times[own].tolist())) == \
            {i * known.b_size + j: n for (i, j), n in links.items()}


@pytest.mark.parametrize("batch,chunk", [(ta.BATCH_BYTES, ta.CHUNK_BYTES), (300, 900)])
def test_align_by_brute_force(spark, known, plain, monkeypatch, batch, chunk):
    """One chunk a task, and many small ones; awkward rows with extra columns."""
    monkeypatch.setattr(ta, "BATCH_BYTES", batch)
    monkeypatch.setattr(ta, "CHUNK_BYTES", chunk)
    rows = [(r[0], r[1]) for r in awkward()]
    got = [tuple(r) for r in ta.align(frame(spark).repartition(3), A_FILE, B_FILE).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, known, plain), key=str)


def test_given_documents_and_empty(spark, known, plain):
    docs = table(spark, SF_SMALL, "documents")
    got = [tuple(r) for r in ta.align(docs, A_FILE, B_FILE).collect()]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got) == sorted(brute(rows, known, plain))
    none = ta.align(empty(spark), A_FILE, B_FILE)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                  "groups_sha256"]
    blank = ta.align(frame(spark, [(1, "", None, None, None), (2, "▁", None, None, None)]), A_FILE, B_FILE).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_forgotten_between_batches(known, plain, monkeypatch):
    monkeypatch.setattr(ta, "UNITS", 5)
    for _ in range(3):
        for text in ("one two three four five six seven", "eight nine", "one two"):
            assert ta.Aligned(known, [text]).groups == [written(brute_groups(text, known, plain))]
