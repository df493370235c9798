import random

import public_tokenizers
import pytest
import tiktoken

from cadenza.llm import byte_bpe
from tests.llm.frames import awkward, empty, frame

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.model_proto(byte_bpe.read_ranks(PATH)), PATTERN)


def test_random_text_equals_tiktoken(codec, reference):
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x300)] + ["\x1c", "\x85", " ", "　", "中", "\U0001f600", "⁇", "▁"] * 20
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_every_code_point(codec, reference):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(points), 4000):
        text = " ".join(points[i:i + 4000])
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_long_pre_tokens(codec, reference):
    for text in ("a" * 100_000, " " * 30_000, "é" * 30_000):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_cache_starts_anew(codec, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 3)
    text = "one two three four five six one two three"
    assert codec.encode(text) == reference.encode_ordinary(text)


def test_frames(spark, reference):
    rows = awkward()
    got = byte_bpe.transcode(frame(spark), PATH, PATTERN).collect()
    want = sorted((str(r[0]), reference.encode_ordinary(r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert sorted(bytes(r.decoded) for r in got) == sorted((r[1] or "").encode() for r in rows)
    ids = byte_bpe.encode(frame(spark), PATH, PATTERN)
    back = byte_bpe.decode(ids, PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r[1] or "").encode() for r in rows)
    assert byte_bpe.transcode(empty(spark), PATH, PATTERN).count() == 0
