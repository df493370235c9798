"""Counts of whole texts, taken on the UTF-8 bytes of Arrow batches.

Used by the quality rules and the rule ensemble. All counts are bigint; a
null or empty text has zeros everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.llm.words import SpanHash, chunks, covered, find_words, mix64

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_hash = SpanHash(3)


def _table(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table(SYMBOLS)
_UPPER, _DIGIT = _table(map(chr, range(65, 91))), _table(map(chr, range(48, 58)))
_STOP = _table(".!?")
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False  # continuation bytes start no code point

NAMES = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
         "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_stops", "longest_word"]


def _per_row(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][offsets])


def _per_doc(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(weight, dtype=np.int64)][first])


def _twice(key: np.ndarray) -> np.ndarray:
    """Entries whose key occurs twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.r_[False, same] | np.r_[same, False] if len(key) else False
    return out


def _lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier one)."""
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    return len(lines), len(lines) - len(set(lines))


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every row of one chunk of texts."""
    words = find_words(data, offsets)
    point = _POINT[data]
    points = np.r_[0, np.cumsum(point, dtype=np.int64)]
    length = points[words.end] - points[words.start]
    h = _hash(data, words.start, words.end)
    salt = mix64(words.doc.astype(np.uint64) + np.uint64(1))

    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        whole = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        three = mix64(h[:-2]) + np.uint64(3) * mix64(h[1:-1] + np.uint64(7)) + h[2:]
        repeated[whole] = _twice(mix64(three[whole]) ^ salt[whole])
    order = np.lexsort((h, words.doc))
    hd, dd = h[order], words.doc[order]
    new = np.r_[True, (hd[1:] != hd[:-1]) | (dd[1:] != dd[:-1])] if len(hd) else np.zeros(0, bool)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, words.doc, length)

    raw = data.tobytes()
    lines = [_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    lines = np.array(lines, np.int64).reshape(-1, 2)
    return {"n_chars": np.diff(points[offsets]),
            "n_words": np.diff(words.first),
            "word_chars": _per_doc(length, words.first),
            "n_symbols": _per_row(_SYMBOL[data], offsets),
            "n_lines": lines[:, 0], "n_dup_lines": lines[:, 1],
            "n_repeat_words": _per_doc(covered(repeated, 3), words.first),
            "n_distinct_words": _per_doc(new, words.first),
            "n_upper": _per_row(_UPPER[data], offsets),
            "n_digits": _per_row(_DIGIT[data], offsets),
            "n_stops": _per_row(_STOP[data], offsets),
            "longest_word": longest}


def with_statistics(docs: DataFrame, keep: list[str], names: list[str] = NAMES,
                    text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of every row and the named counts of its text."""
    schema = docs.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out = ", ".join([kinds, *(f"{n} bigint" for n in names)])

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, text=text_col):
                found = counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(found[n], pa.int64()) for n in names],
                    [*keep, *names])

    return docs.select(*keep, text_col).mapInArrow(run, out)
