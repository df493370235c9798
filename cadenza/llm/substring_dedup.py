"""Removal of repeated word windows by Rabin-Karp hashes.

Every window of ``width`` consecutive words of every text gets a
polynomial hash. The windows are shuffled by a second polynomial hash of
the same words, with a multiplier of its own, into parts of bounded size and counted there: a window whose sequence also
starts in a document with a smaller id is reported back to its document,
where flagged windows merge into maximal removal intervals.

Only hashes travel, packed in binary rows of many documents: 8 bytes a
window out, 8 bytes a repeated window back; texts meet their flags
compressed. Before the shuffle a task
keeps one entry, that of the smallest id, of each window it has met, and
flags the other documents at once, so a window that a third of all
documents share arrives once per task batch, not once per document. The
number of parts follows the bytes of text, so no task grows with the
corpus. Windows of different documents are told by 64 bits plus the part,
which the first hash does not determine: of 5e9 windows in 3,600 parts
(about 30 GB) 0.0002 pairs of different ones are expected to collide.

Defined results: a null text is empty; a text of fewer words than a window
keeps all; rows of one id are one document (a window repeated only among
them stays); a null id counts as larger than every other id; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.words import (SpanHash, chunks, compress_texts, covered, find_words, mix64, texts_of,
                               xxh64_of_long)

#: Bytes of text whose windows make one part, and that meet in one task
#: when the removals are applied.
PART_BYTES, APPLY_BYTES = 8 << 20, 8 << 20
#: Windows that a task gathers before it sends them on.
BATCH_WINDOWS = 1_000_000
NULL_ID = 2**63 - 1

_hash = SpanHash(20)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def window_hashes(data, offsets, words, width: int, parts: int = 1):
    """(hash, document, index of the first word, part) of every window; the
    part comes from a second hash."""
    h = _hash(data, words.start, words.end)
    n = len(h) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.int32)
    whole = np.flatnonzero(words.doc[:n] == words.doc[width - 1:])

    def polynomial(multiplier):
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * multiplier + h[j:n + j]
        return mix64(out[whole])

    part = _part_of(polynomial(_SECOND), parts) if parts > 1 else np.zeros(len(whole), np.int32)
    return polynomial(_MULTIPLIER), words.doc[whole], whole, part


def _part_of(second: np.ndarray, parts: int) -> np.ndarray:
    return (((second >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(xxh64_of_long(ids).view(np.int64), buckets).astype(np.int32)


def _pack(group: np.ndarray, doc: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """One (group, documents, counts, hashes) for each group; the entries of
    a group are in document order."""
    order = np.lexsort((doc, group))
    group, doc, h = group[order], doc[order], h[order]
    head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, int)
    counts = np.diff(np.r_[head, len(h)]).astype(np.int32)
    of = group[head]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    for a, b in zip(first, np.r_[first[1:], len(of)]):
        lo, hi = head[a], head[b] if b < len(head) else len(h)
        yield int(of[a]), doc[head[a:b]].tobytes(), counts[a:b].tobytes(), h[lo:hi].tobytes()


def _unpack(docs, counts, hashes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in docs] or [np.zeros(0, np.int64)])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in counts] or [np.zeros(0, np.int32)])
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in hashes] or [np.zeros(0, np.uint64)])
    return np.repeat(ids, n), h


def _repeats(ids: np.ndarray, h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries that are the first of their hash and part, entries with a
    smaller id before them). Entries are distinct (id, hash, part)."""
    order = np.lexsort((ids, part, h))
    hs, ps = h[order], part[order]
    new = np.r_[True, (hs[1:] != hs[:-1]) | (ps[1:] != ps[:-1])] if len(h) else np.zeros(0, bool)
    return order[new], order[~new]


def _distinct(ids: np.ndarray, h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((part, h, ids))
    ids, h, part = ids[order], h[order], part[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (part[1:] != part[:-1])] \
        if len(h) else np.zeros(0, bool)
    return ids[new], h[new], part[new]


_PACKED = "part int, bucket int, docs binary, counts binary, hashes binary"
_NAMES = ["part", "bucket", "docs", "counts", "hashes"]


def _row_ids(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _send(width: int, parts: int, buckets: int):
    """Map side: rows of hashes by part; rows of flags carry their bucket."""

    def rows(ids, h, part):
        ids, h, part = _distinct(ids, h, part)
        first, later = _repeats(ids, h, part)
        out = [(p, -1, *x) for p, *x in _pack(part[first], ids[first], h[first])]
        flags = _pack(_bucket_of(ids[later], buckets), ids[later], h[later])
        out += [(b % parts, b, *x) for b, *x in flags]
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part, data, offsets in chunks(batch):
                words = find_words(data, offsets)
                h, doc, _, of = window_hashes(data, offsets, words, width, parts)
                held.append((_row_ids(part.column(0))[doc], h, of))
                n += len(h)
                if n >= BATCH_WINDOWS:
                    yield rows(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if n:
            yield rows(*(np.concatenate(x) for x in zip(*held)))

    return run


def _count(buckets: int):
    """Reduce side of one part: flags of every repeated window by bucket."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = pdf[pdf["bucket"] < 0]
        ids, h = _unpack(sent["docs"], sent["counts"], sent["hashes"])
        ids, h, part = _distinct(ids, h, np.zeros(len(h), np.int32))  # all of one part
        _, later = _repeats(ids, h, part)
        flags = _pack(_bucket_of(ids[later], buckets), ids[later], h[later])
        out = pd.DataFrame(list(flags), columns=["bucket", "docs", "counts", "hashes"])
        through = pdf.loc[pdf["bucket"] >= 0, ["bucket", "docs", "counts", "hashes"]]
        return pd.concat([out, through], ignore_index=True)

    return run


def _apply(width: int):
    """Cuts the flagged windows out of the documents of one bucket."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        ids, h = _unpack(*(flags.column(n).to_pylist() for n in ("docs", "counts", "hashes")))
        order = np.lexsort((h, ids))
        ids, h = ids[order], h[order]
        texts = pa.array(texts_of(docs), pa.large_binary())
        batch = pa.RecordBatch.from_arrays([docs.column("id").combine_chunks(), texts], ["id", "text"])
        out = [_cut(part, data, offsets, ids, h) for part, data, offsets in chunks(batch)]
        if not out:
            return pa.Table.from_batches([], OUT_ARROW)
        return pa.Table.from_batches(out)

    def _cut(part, data, offsets, ids, h):
        keys = _row_ids(part.column(0))
        words = find_words(data, offsets)
        wh, wdoc, at, _ = window_hashes(data, offsets, words, width)
        lo, hi = np.searchsorted(ids, keys), np.searchsorted(ids, keys, side="right")
        first = np.searchsorted(wdoc, np.arange(len(keys) + 1))
        flag = np.zeros(len(words.start), bool)
        for i in np.flatnonzero(hi > lo):
            a, b = first[i], first[i + 1]
            flag[at[a:b]] = np.isin(wh[a:b], h[lo[i]:hi[i]], kind="sort")
        gone = covered(flag, width)
        n_words, n_removed, kept, removed = [], [], [], []
        raw = data.tobytes()
        for i in range(len(keys)):
            a, b = words.first[i], words.first[i + 1]
            tokens = raw[offsets[i]:offsets[i + 1]].split()
            mask = gone[a:b]
            lost = int(mask.sum())
            spans = []
            if lost:
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
                spans = [{"first_word": int(x), "end_word": int(y)} for x, y in edge.reshape(-1, 2)]
                tokens = [t for t, m in zip(tokens, mask) if not m]
            n_words.append(b - a)
            n_removed.append(lost)
            kept.append(b" ".join(tokens).decode("utf-8"))
            removed.append(spans)
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n_words, pa.int64()),
             pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()),
             pa.array(removed, _SPANS)], schema=OUT_ARROW)

    return run


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                       ("kept", pa.string()), ("removed", _SPANS)])
OUT = ("doc_id bigint, n_words bigint, n_removed bigint, kept string, "
       "removed array<struct<first_word:bigint,end_word:bigint>>")


def sizes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of text in all rows."""
    return docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed`` of every row: the words
    left, joined by one space, and the maximal removed word intervals."""
    spark = docs.sparkSession
    total = sizes(docs, text_col)
    width_set = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * width_set, -(-total // PART_BYTES))
    buckets = max(2 * width_set, -(-total // APPLY_BYTES))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sent = rows.mapInArrow(_send(width, parts, buckets), _PACKED)
    flags = sent.groupBy("part").applyInPandas(
        _count(buckets), "bucket int, docs binary, counts binary, hashes binary")

    bucket = F.pmod(F.xxhash64(F.coalesce("id", F.lit(NULL_ID))), F.lit(buckets)).cast("int").alias("bucket")
    keyed = rows.select(bucket, "id", "text").mapInArrow(compress_texts, "bucket int, id bigint, packed binary")
    return keyed.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(
        _apply(width), OUT)
