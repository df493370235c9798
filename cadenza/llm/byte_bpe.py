"""Byte-level BPE encoding and decoding with a sentencepiece model.

The model is written straight from a rank vocabulary: every token's bytes
are mapped to printable characters, one character per byte, and become a
piece whose score is its negative rank, so that the best-scoring merge is
the lowest rank. Normalisation is the identity. Each pre-token is mapped
the same way and encoded alone; decoding maps the pieces of the ids back
to bytes. The vocabulary is read once by the driver; its model (about
1 MB, fixed by the vocabulary) travels with the task.

Defined results: a null or empty text has no tokens; a single pre-token of
any length is encoded whole; repeated rows are encoded alike; other columns
of the input are dropped except the id.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct pre-tokens that a task remembers; beyond it, it starts anew.
CACHE_ENTRIES = 200_000
#: Rows handled at once.
ROWS = 64

_UNKNOWN = "⁇<unk>"


def byte_letters() -> list[str]:
    """A printable character for every byte: visible Latin-1 characters
    stand for themselves, the others take the code points from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError("ranks must run from 0 without a gap")
    return tokens


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece i is token i, the
    unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    letters = byte_letters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    model.pieces.add(piece=_UNKNOWN, score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = model.trainer_spec
    t.model_type = pb.TrainerSpec.BPE
    t.vocab_size = len(model.pieces)
    t.unk_id, t.unk_piece = len(tokens), _UNKNOWN
    t.bos_id = t.eos_id = t.pad_id = -1
    n = model.normalizer_spec
    n.name = "identity"
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, proto: bytes, pattern: str):
        import regex
        import sentencepiece
        self._sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._split = regex.compile(pattern).findall
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self._letters = {b: c for b, c in enumerate(letters)}
        n = self._sp.get_piece_size() - 1
        self._bytes = [bytes(back[c] for c in self._sp.id_to_piece(i)) for i in range(n)]
        self.size = n
        self._known: dict[str, list[int]] = {}

    def _encode_piece(self, pre_token: str) -> list[int]:
        if len(self._known) >= CACHE_ENTRIES:
            self._known.clear()
        mapped = pre_token.encode("utf-8").decode("latin-1").translate(self._letters)
        ids = self._known[pre_token] = self._sp.encode(mapped)
        return ids

    def encode(self, text: str) -> list[int]:
        pre_tokens = self._split(text)
        known = self._known.get
        parts = [known(t) or self._encode_piece(t) for t in pre_tokens]
        return list(chain.from_iterable(parts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(proto: bytes, pattern: str) -> Codec:
    return Codec(proto, pattern)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every text."""
    proto = model_proto(read_ranks(vocabulary))

    def run(batches):
        codec = _codec(proto, pattern)
        for keys, texts in _texts(batches):
            ids = pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, ids], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``decoded`` (binary) of every list of ids."""
    proto = model_proto(read_ranks(vocabulary))

    def run(batches):
        codec = _codec(proto, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                out = [codec.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())],
                                                 [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def transcode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` and what they decode to, ``decoded``, of every
    text, in one pass."""
    proto = model_proto(read_ranks(vocabulary))

    def run(batches):
        codec = _codec(proto, pattern)
        for keys, texts in _texts(batches):
            ids = [codec.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(ids, pa.list_(pa.int32())),
                 pa.array([codec.decode(x) for x in ids], pa.binary())], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, ids array<int>, decoded binary")
