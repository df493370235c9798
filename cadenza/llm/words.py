"""Words of whole Arrow text columns, found on the UTF-8 bytes.

A word is a maximal run of code points other than space and U+0009 to
U+000D. Those separators are single bytes that occur in no multi-byte
sequence, so words are found on the bytes, for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A longer text is handled alone, whole.
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES,
           text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``limit`` bytes of text (one row at
    least), each with its bytes and offsets."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def compress_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, and the last, a text, as compressed bytes:
    for texts that go through a shuffle. A null text is empty."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.num_columns - 1))
        raw = memoryview(data)
        packed = [pack(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())],
                                         [*batch.schema.names[:-1], "packed"])


def texts_of(table: pa.Table) -> list[bytes]:
    """The texts of a table's ``packed`` column."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in table.column("packed").to_pylist()]


@dataclass
class Words:
    """Byte spans of the words of some texts, in order; ``doc`` is the row
    of each word, ``first`` the index of each row's first word (one entry
    more than rows)."""
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    inside = ~separator[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[heads[1:] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(start, end, doc, first)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def xxh64_of_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of 64-bit integers, as ``xxhash64`` of a bigint column."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5))

    def rotl(v, r):
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    h = np.uint64((seed + int(p5) + 8) % 2**64) ^ (rotl(x.view(np.uint64) * p2, 31) * p1)
    h = rotl(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """Polynomial (Rabin-Karp) hashes modulo 2^64 of byte spans.

    Every byte value stands for a random 64-bit number. With prefix sums of
    ``code[b_i] * base^i`` the hash of any span is one difference times a
    power of the inverse base, so all spans of a text cost a few passes.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        base = int(rng.integers(0, 2**61)) * 8 + 3
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.powers = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, b in (("powers", self.base), ("back", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.powers[:len(data)], out=sums[1:])
        out = (sums[end] - sums[start]) * self.back[start]
        return mix64(out + (end - start).astype(np.uint64))


def covered(flag: np.ndarray, width: int) -> np.ndarray:
    """Positions covered by a window of ``width`` that starts at a flagged
    position."""
    steps = np.zeros(len(flag) + width, np.int32)
    at = np.flatnonzero(flag)
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps[:len(flag)]) > 0
