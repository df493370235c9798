"""Cross-tokenizer alignment of every text.

A text is encoded by two tokenizers: A (byte-level BPE, a ``tokenizers``
file) reads a space and the text, B (a sentencepiece model, which adds that
space itself) reads the text. Both sets of tokens cover the same bytes. In
a batch of documents two ``merge_asof`` joins, keyed by document, give every
token the other side's token that covers its start. Their union holds all
overlaps, and overlaps with equal ends cut the tokens into groups. Tokens
of one group are linked.

Three steps:

* encode: a batch's tokens are aligned, and links become (document, pair of
  ids, times). Up to ``CHUNK_BYTES`` of text make a chunk: one row with its
  documents, its distinct pairs with the number of documents that hold them,
  and the compressed matrix of documents by pairs;
* count: documents per pair over all chunks, and the highest count of each
  A id;
* look up: every chunk's pairs meet the counts in a join, a row for each
  chunk and pair, and come back to the chunk's matrix in a cogroup. A chunk
  is of bounded size, or one document.

White space separates what either tokenizer merges, so texts are cut before
runs of it and the tokens of a unit are remembered for the next time.

Defined results: a null or empty text, and one whose tokens do not join to
its bytes on either side (it holds U+2581, say), has no tokens: zero counts
and empty groups. Strings of special tokens are plain text. Every row is a
document, repeated rows and ids included. Long texts are encoded whole and
are chunks of their own. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.byte_bpe import byte_letters
from cadenza.session import scratch_table

#: Bytes of text aligned at once, and of a chunk. A longer text is alone.
BATCH_BYTES = 1 << 20
CHUNK_BYTES = 24 << 20
#: Units a task remembers, and their tokens; beyond it, it starts anew.
UNITS, UNIT_TOKENS = 200_000, 4_000_000
#: Units encoded as one text.
JOINED = 2048
#: Links of a group from which its ids are counted before they are paired.
MANY_LINKS = 1 << 14
#: Links made at once.
LINKS = 1 << 20

#: White space, and what only some take for it.
_SPACE = [" ", *"\t\n\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
_UNSURE = [*"\x1c\x1d\x1e\x1f"]


class Tokenizers:
    """Both tokenizers, and the tokens of the units met so far."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.encode_special_tokens = True
        model = pb.ModelProto()
        model.ParseFromString(b_file)
        self.prefix = " " if model.normalizer_spec.add_dummy_prefix else ""
        model.normalizer_spec.add_dummy_prefix = False  # a unit holds its space
        self.b = SentencePieceProcessor(model_proto=model.SerializeToString())
        back = {c: i for i, c in enumerate(byte_letters())}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(back.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == p.BYTE
                        else p.piece.replace("▁", " ").encode("utf-8") for p in model.pieces]
        longer = [p.piece for p in model.pieces if len(p.piece) > 1 and p.type != p.BYTE]
        if any("▁" in p.lstrip("▁") for p in longer):
            raise ValueError("the sentencepiece model has pieces with a space after other letters")
        # a text with a character that may be merged with those before it is one unit
        unsure = [*_UNSURE, *(c for c in _SPACE if c in set().union(*longer))]
        self._space = space = "".join(c for c in _SPACE if c not in unsure)
        self._unsure = re.compile(f"[{''.join(unsure)}]").search
        self._units = re.compile(f"[{space}]*[^{space}]+|[{space}]+").findall
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self._forget()

    def _forget(self):
        self.at: dict[str, int] = {}
        self.flat = (array("i"), array("i"))
        self.count = (array("q"), array("q"))
        self.whole = array("b")

    def units(self, text: str) -> list[str]:
        text = f"{self.prefix}{text}"
        return [text] if self._unsure(text) else self._units(text)

    def learn(self, units: list[str]) -> None:
        """Tokens of all units that are not known yet. Call it with all
        units of a batch: it may forget earlier ones."""
        if len(self.at) > UNITS or len(self.flat[0]) > UNIT_TOKENS:
            self._forget()
        new = set(units).difference(self.at)
        alone = [u for u in new if u[0] not in self._space or u[-1] in self._space or self._unsure(u)]
        joined = list(new.difference(alone))
        for i in range(0, len(joined), JOINED):
            self._learn(joined[i:i + JOINED])
        for unit in alone:
            self._learn([unit])

    def _learn(self, units: list[str]) -> None:
        """Tokens of units that can be encoded as one text: each starts with
        white space and ends without."""
        text = "".join(units)
        ids = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text)
        raw = text.encode("utf-8")
        whole = all(b"".join(map(of.__getitem__, x)) == raw for of, x in zip((self.a_bytes, self.b_bytes), ids))
        if not whole and len(units) > 1:
            for unit in units:
                self._learn([unit])
            return
        ends = np.cumsum([len(u.encode("utf-8")) for u in units])
        for side, length in enumerate((self.a_len, self.b_len)):
            last = np.searchsorted(np.cumsum(length[ids[side]]), ends) + 1 if whole else [len(ids[side])]
            self.flat[side].extend(ids[side])
            self.count[side].extend(np.diff(last, prepend=0).tolist())
        self.at.update(zip(units, range(len(self.whole), len(self.whole) + len(units))))
        self.whole.extend([whole] * len(units))

    def tokens(self, units: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known units' tokens in order, and tokens per unit."""
        flat = np.array(self.flat[side], np.int64)
        count = np.array(self.count[side], np.int64)
        n, first = count[units], (np.cumsum(count) - count)[units]
        return flat[_ranges(first, n)], n


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + n[i] - 1`` for every i, in order."""
    total = int(n.sum())
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)


@lru_cache(maxsize=1)
def _loaded(a_file: bytes, b_file: bytes) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """All overlapping tokens ``ia, ib`` with their ends. ``a`` and ``b``
    have ``doc, start, end`` in order of ``start``, which rises over all
    documents; the tokens of a document cover the same bytes in both."""
    a = a.assign(ia=np.arange(len(a)))
    b = b.assign(ib=np.arange(len(b)))
    ab = pd.merge_asof(a, b[["doc", "start", "end", "ib"]], on="start", by="doc", suffixes=("_a", "_b"))
    ba = pd.merge_asof(b, a.rename(columns={"start": "a_start"})[["doc", "a_start", "end", "ia"]],
                       left_on="start", right_on="a_start", by="doc", suffixes=("_b", "_a"))
    ba = ba[ba["a_start"].to_numpy() < ba["start"].to_numpy()]  # equal starts are in both
    keep = ["ia", "ib", "end_a", "end_b"]
    return pd.concat([ab[keep], ba[keep]], ignore_index=True)


def groups(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of both sides, numbered from 0 in order."""
    both = overlaps(a, b)
    equal = both[both["end_a"].to_numpy() == both["end_b"].to_numpy()]
    out = []
    for side, name in ((a, "ia"), (b, "ib")):
        closes = np.zeros(len(side) + 1, np.int64)
        closes[equal[name].to_numpy() + 1] = 1
        out.append(np.cumsum(closes)[:-1])
    return out[0], out[1]


def linked(doc: np.ndarray, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray,
           na: np.ndarray, nb: np.ndarray, b_size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, pair, times) of the links of some groups, each document
    and pair as often as it comes. A group has its document, the first token
    and the number of tokens on either side."""
    size = na * nb
    plain = np.flatnonzero(size < MANY_LINKS)
    for part in np.split(plain, np.searchsorted(np.cumsum(size[plain]), np.arange(LINKS, size[plain].sum(), LINKS))):
        if not len(part):
            continue
        rows = np.repeat(part, na[part])  # a row for each A token
        ids = a[_ranges(first_a[part], na[part])]
        n = nb[rows]
        pair = np.repeat(ids, n) * b_size + b[_ranges(first_b[rows], n)]
        yield np.repeat(doc[rows], n), pair, np.ones(len(pair), np.int64)
    for g in np.flatnonzero(size >= MANY_LINKS):
        ua, ca = np.unique(a[first_a[g]:first_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[first_b[g]:first_b[g] + nb[g]], return_counts=True)
        step = max(1, LINKS // len(ub))
        for i in range(0, len(ua), step):
            pair = (ua[i:i + step, None] * b_size + ub[None, :]).ravel()
            yield np.full(len(pair), doc[g]), pair, (ca[i:i + step, None] * cb[None, :]).ravel()


def _added(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each document and pair, by document, then pair."""
    if not len(doc):
        return doc, pair, times
    width = int(pair.max()) + 1
    if (int(doc.max()) + 1) * width < 1 << 62:
        key = doc * width + pair
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    else:
        order = np.lexsort((pair, doc))
        head = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(pair[order]) != 0)])
    return doc[order][head], pair[order][head], np.add.reduceat(times[order], head)


class Aligned:
    """Alignment of a batch of texts: per text ``n_a, n_b, n_groups,
    n_links`` and ``groups`` (as text), and the entries ``doc, pair, times``
    of its links, by document, then pair."""

    def __init__(self, t: Tokenizers, texts: list[str | None]):
        per = [t.units(x) if x else [] for x in texts]
        flat = list(chain.from_iterable(per))
        t.learn(flat)
        n_units = np.array([len(x) for x in per], np.int64)
        unit = np.fromiter(map(t.at.__getitem__, flat), np.int64, len(flat))
        doc = np.repeat(np.arange(len(texts)), n_units)
        whole = np.array(t.whole, bool)[unit] if len(unit) else np.zeros(0, bool)
        broken = np.bincount(doc[~whole], minlength=len(texts)) > 0
        unit, doc = unit[~broken[doc]], doc[~broken[doc]]
        ids, frames = [], []
        for side, length in ((0, t.a_len), (1, t.b_len)):
            tokens, n = t.tokens(unit, side)
            end = np.cumsum(length[tokens])
            ids.append(tokens)
            frames.append(pd.DataFrame({"doc": np.repeat(doc, n), "start": end - length[tokens], "end": end}))
        (a, b), (fa, fb) = ids, frames
        ga, gb = groups(fa, fb)
        doc_a, doc_b = fa["doc"].to_numpy(), fb["doc"].to_numpy()
        n_groups = int(ga[-1]) + 1 if len(ga) else 0
        na, nb = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        own = doc_a[first_a] if n_groups else np.zeros(0, np.int64)
        n = len(texts)
        self.n_a, self.n_b = np.bincount(doc_a, minlength=n), np.bincount(doc_b, minlength=n)
        self.n_groups = np.bincount(own, minlength=n)
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, own, na * nb)
        self.groups = _written(a, b, na, nb, own, n, t)
        found = [_added(*x) for x in linked(own, a, b, first_a, first_b, na, nb, t.b_size)]
        none = np.zeros(0, np.int64)
        self.doc, self.pair, self.times = _added(*(np.concatenate([none, *x]) for x in zip(*found))) \
            if found else (none, none, none)


def _written(a, b, na, nb, own, n: int, t: Tokenizers) -> list[str]:
    """``a1,a2|b1;a3|b2`` of every text."""
    names = _names(t.a_size, t.b_size)
    n_groups = len(na)
    # a token's name ends with what follows it: another token, the other side or the next group
    sort_a, sort_b = np.zeros(len(a), np.int64), np.full(len(b), 2, np.int64)
    sort_a[np.cumsum(na) - 1] = 1
    sort_b[np.cumsum(nb) - 1] = 3
    code = np.empty(len(a) + len(b), np.int64)
    start = np.cumsum(na + nb) - (na + nb)
    code[_ranges(start, na)] = sort_a * t.a_size + a
    code[_ranges(start + na, nb)] = 2 * t.a_size + (sort_b - 2) * t.b_size + b
    per = np.bincount(own, weights=na + nb, minlength=n).astype(np.int64) if n_groups else np.zeros(n, np.int64)
    ends = np.cumsum(per).tolist()
    get, code = names.__getitem__, code.tolist()
    return ["".join(map(get, code[i:j]))[:-1] for i, j in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def _names(a_size: int, b_size: int) -> list[str]:
    return [f"{i}{c}" for c, size in ((",", a_size), ("|", a_size), (",", b_size), (";", b_size))
            for i in range(size)]


def _planes(x: np.ndarray) -> bytes:
    """Small non-negative integers, compressed by byte position."""
    import zstandard
    x = np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=1).compress(x.T.tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    import zstandard
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(x.T).view(np.uint32).ravel().astype(np.int64)


#: What a text has before counts are known.
PER_TEXT = ["n_a", "n_b", "n_groups", "n_links"]


def _chunk(key: int, ids: list[pa.Array], parts: list[Aligned], schema: pa.Schema) -> pa.RecordBatch:
    """One row: texts, distinct pairs with their documents, and the matrix
    as entries per text, steps between pair numbers, and times."""
    sizes = [len(p.n_a) for p in parts]
    doc = np.concatenate([p.doc + lo for p, lo in zip(parts, np.cumsum([0, *sizes]))])
    pairs, at = np.unique(np.concatenate([p.pair for p in parts]), return_inverse=True)
    docs = np.bincount(at, minlength=len(pairs))
    per = np.bincount(doc, minlength=sum(sizes))
    step = np.diff(at, prepend=0)
    step[(np.cumsum(per) - per)[per > 0]] = at[(np.cumsum(per) - per)[per > 0]]
    row = {"chunk": key, "pairs": pairs, "docs": docs, "per": _planes(per), "step": _planes(step),
           "times": _planes(np.concatenate([p.times for p in parts])),
           "ids": pa.concat_arrays(ids), "groups": pa.array(list(chain.from_iterable(p.groups for p in parts))),
           **{c: np.concatenate([getattr(p, c) for p in parts]) for c in PER_TEXT}}
    columns = []
    for field in schema:
        x = row[field.name]
        if pa.types.is_list(field.type):
            values = (x if isinstance(x, pa.Array) else pa.array(x)).cast(field.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                           .cast(field.type))
        else:
            columns.append(pa.array([x], field.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None], int]]:
    """Ids and texts of at most ``BATCH_BYTES`` (one text at least)."""
    for batch in batches:
        size = pa.compute.binary_length(batch.column(1).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
        total, i, n = np.cumsum(size), 0, batch.num_rows
        while i < n:
            before = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, before + BATCH_BYTES, side="right")))
            yield batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist(), int(total[j - 1]) - before
            i = j


def chunks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each chunk of the documents (see ``_chunk``)."""
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        a_file, b_file = fa.read(), fb.read()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"chunk bigint, ids array<{kind}>, {', '.join(f'{c} array<bigint>' for c in PER_TEXT)}, "
              "groups array<string>, pairs array<bigint>, docs array<bigint>, per binary, step binary, times binary")

    def run(batches):
        t = _loaded(a_file, b_file)
        ids, parts, held, number = [], [], 0, TaskContext.get().partitionId() << 32
        out = None
        for keys, texts, size in _batches(batches):
            if out is None:
                out = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(keys.type)),
                                 *((c, pa.list_(pa.int64())) for c in PER_TEXT), ("groups", pa.list_(pa.string())),
                                 ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64())),
                                 ("per", pa.binary()), ("step", pa.binary()), ("times", pa.binary())])
            if parts and held + size > CHUNK_BYTES:
                yield _chunk(number, ids, parts, out)
                ids, parts, held, number = [], [], 0, number + 1
            ids.append(keys)
            parts.append(_digested(Aligned(t, texts)))
            held += size
        if parts:
            yield _chunk(number, ids, parts, out)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _digested(x: Aligned) -> Aligned:
    """Groups as their digests; a text without tokens has none."""
    from hashlib import sha256
    x.groups = [sha256(g.encode("ascii")).hexdigest() if g else "" for g in x.groups]
    x.pair = x.pair.astype(np.uint32) if len(x.pair) and x.pair.max() < 1 << 32 else x.pair
    x.doc, x.times = x.doc.astype(np.uint32), x.times.astype(np.uint32)
    return x


def pair_counts(parts: DataFrame, b_size: int) -> DataFrame:
    """``pair, docs, best`` of every pair of ids: the documents that hold it
    linked, and whether no pair of its A id has more."""
    counts = parts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")) \
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs"))
    counts = scratch_table(counts.withColumn("a", F.expr(f"pair div {b_size}")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _finished(id_col: str):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(found.column("pair").to_numpy())
        docs = found.column("docs").to_numpy()[order].astype(np.int64)
        best = found.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        row = {c: chunk.column(c).chunk(0) for c in chunk.column_names}
        per, step, times = (_numbers(row[c][0].as_py()) for c in ("per", "step", "times"))
        first = np.cumsum(per) - per
        run_of = np.cumsum(step)
        lead = first[per > 0]
        base = run_of[lead] - step[lead]
        at = run_of - np.repeat(base, per[per > 0])
        text = np.repeat(np.arange(len(per)), per)
        sums = []
        for weight in (best, docs):
            total = np.zeros(len(per), np.int64)
            np.add.at(total, text, times * weight[at])
            sums.append(total)
        return pa.table({id_col: row["ids"].flatten(), **{c: row[c].flatten() for c in PER_TEXT},
                         "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["groups"].flatten()})
    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_a, n_b`` tokens, ``n_groups``, ``n_links``,
    ``n_best`` links whose pair is held by as many documents as any pair of
    its A id, ``count_sum`` over links of the documents that hold their
    pair, and the digest of the groups."""
    kind = docs.schema[id_col].dataType.simpleString()
    parts = scratch_table(chunks(docs, a_path, b_path, id_col, text_col))
    found = parts.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")) \
        .join(pair_counts(parts, _b_size(b_path)), "pair").select("of", "pair", "docs", "best")
    rows = parts.select("chunk", "ids", *PER_TEXT, "groups", "per", "step", "times")
    return rows.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(
        _finished(id_col), f"`{id_col}` {kind}, {', '.join(f'{c} bigint' for c in PER_TEXT)}, "
                           "n_best bigint, count_sum bigint, groups_sha256 string")


def _b_size(path: str) -> int:
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path).get_piece_size()
