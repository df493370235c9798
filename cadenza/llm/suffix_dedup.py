"""Removal of repeated byte strings with suffix arrays.

A byte goes when it is covered by a string of ``length`` bytes that also
starts anywhere else in the corpus. Suffix arrays of the whole text would
be many times its size, so three steps narrow down what they must hold,
losing no repeat:

1. Segments. Every string of ``length`` bytes is told by an anchor, the
   gram of smallest hash within it; equal strings have equal anchors. The
   starts of one anchor in a row make a segment. Segments are told by
   (anchor, content) hashes; a task sends one row for its copies of one.
2. Shards. Segments that no other place can share a string with (one
   place, and no other content of its anchor) are left out. One copy of
   every other segment is cut from a text and dealt by anchor into shards
   of bounded size, with the number of its places. Each shard gets a
   suffix array by Larsson-Sadakane refinement (sort by a prefix, then
   re-sort only unsorted groups by the rank of the suffix twice as far on),
   and common prefixes by Kasai's recurrence in its permuted form: along
   the text, a prefix is one shorter than the one before, and only where
   that chain breaks are bytes compared. Neighbours in the array with a
   common prefix of ``length`` are one string; it is repeated where their
   segments have two places or more. What is found on a segment holds at
   all its places.
3. Merging. The segments of an anchor with more than ``HOT_BYTES`` of
   contents are dealt over several shards. Those shards also return the
   sorted fingerprints of their distinct strings, by fingerprint range, and
   the strings of other shards are found in them by binary search.

Defined results: texts are UTF-8 bytes, a null text is empty; rows with
the same id and text each count as a place of their own; a kept remainder
need not be valid UTF-8, so it is binary; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.words import SpanHash, chunks, compress_texts, texts_of
from cadenza.session import checkpoint, scratch_table

#: Bytes of text handled at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Segments that a task gathers before it sends them on.
BATCH_SEGMENTS = 200_000
#: Bytes of segments in a shard; of one anchor's segments before they are
#: dealt over several; of text that meets in one task.
SHARD_BYTES, HOT_BYTES, APPLY_BYTES = 1 << 20, 256 << 10, 8 << 20
#: A segment's place: first start times this (or the next power of two that
#: its further starts need), plus its further starts.
PLACE = 4096

_anchor_hash, _content_hash, _string_hash = SpanHash(81), SpanHash(82), SpanHash(83)
_POSITION = np.uint64((1 << 28) - 1)


def _gram(length: int) -> int:
    return max(4, length * 8 // 25)


def place_unit(length: int) -> int:
    """What a first start is multiplied by in a place: more than the further
    starts of any segment, which has one for each gram of a string at most."""
    return max(PLACE, 1 << (length - _gram(length) + 1).bit_length())


def segments(data: np.ndarray, offsets: np.ndarray, length: int):
    """(row, first start, last start, anchor, content) of every segment;
    starts are within the row."""
    gram = _gram(length)
    width = length - gram + 1
    step = max(1, PIECE - length)
    out = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]]
    for base in range(0, len(data) - length + 1, step):
        part = data[base:base + step + length - 1]
        n = len(part) - length + 1
        grams = np.arange(len(part) - gram + 1)
        h = _anchor_hash(part, grams, grams + gram)
        # smallest hash, then leftmost; the hash part is the same in every piece
        low = (h >> np.uint64(28) << np.uint64(28)) | grams.astype(np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[width - span:width - span + n])
        row = np.searchsorted(offsets, np.arange(base, base + n), side="right") - 1
        p = np.flatnonzero(np.arange(base, base + n) + length <= offsets[row + 1])
        if not len(p):
            continue
        row, at = row[p], (low[p] & _POSITION).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        first, last = p[head], np.r_[p[head[1:] - 1], p[-1]]
        rows = row[head]
        out.append([rows, base + first - offsets[rows], base + last - offsets[rows], h[at[head]],
                    _content_hash(part, first, last + length)])
    return [np.concatenate(c) for c in zip(*out)]


def _find(length: int):
    """Distinct segments of each batch, each with its places."""
    unit = place_unit(length)

    def rows(held):
        key, place, anchor, content = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, key, content, anchor))
        key, place, anchor, content = key[order], place[order], anchor[order], content[order]
        head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])
        ends = pa.array(np.r_[head, len(key)].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor[head].view(np.int64)), pa.array(content[head].view(np.int64)),
             pa.ListArray.from_arrays(ends, pa.array(key)), pa.ListArray.from_arrays(ends, pa.array(place))],
            ["anchor", "content", "rows", "places"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at = 0
            for part, data, offsets in chunks(batch):
                own = keys[at:at + part.num_rows]
                at += part.num_rows
                row, first, last, anchor, content = segments(data, offsets, length)
                held.append((own[row], first * unit + (last - first), anchor, content))
                n += len(row)
                if n >= BATCH_SEGMENTS:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


_FOUND = "anchor bigint, content bigint, rows array<bigint>, places array<bigint>"


def suffix_array(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by
    Larsson-Sadakane refinement. ``left`` has the symbols left in each
    suffix's segment; beyond its end it is smaller than any byte."""
    n = len(text)
    symbol = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)]
    key = np.zeros(n, np.uint64)
    h = 7
    for j in range(h):
        key = (key << np.uint64(9)) | np.where(left > j, symbol[j:j + n], np.uint64(0))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    slots = np.arange(n)
    rank = np.zeros(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(new, slots, 0))
        rank[order[slots]] = head
        # go on with groups of two or more; a group of suffixes that have
        # ended is of one length and stays as it is
        single = new & np.r_[new[1:], True]
        slots = slots[~single & (left[order[slots]] >= h)]
        if h >= depth or len(slots) < 2:
            return order
        at = order[slots]
        pair = (rank[at] << 32) | np.where(left[at] > h, rank[np.minimum(at + h, n - 1)] + 1, 0)
        again = np.argsort(pair, kind="stable")
        order[slots], pair = at[again], pair[again]
        new = np.r_[True, pair[1:] != pair[:-1]]
        h *= 2


def _common(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of suffix pairs, eight bytes at a time."""
    limit = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):
        x = words[a[active] + out[active]] ^ words[b[active] + out[active]]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        out[active] += same
        active = active[(x == 0) & (out[active] < limit[active])]
    return np.minimum(out, limit)


def common_prefixes(text: np.ndarray, left: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(predecessor in ``order``, common prefix with it) by text position,
    -1 and 0 for the first and for positions that are not in ``order``."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.zeros(n + 8, np.uint64)
    for j in range(8):
        words[:n] |= padded[j:j + n].astype(np.uint64) << np.uint64(8 * j)
    todo = np.flatnonzero(before >= 0)
    follows = np.zeros(n, bool)  # position continues the chain of the one before
    follows[1:] = (before[1:] >= 1) & (before[:-1] == before[1:] - 1) & (before[:-1] >= 0)
    while len(todo):
        # heads: no chain to follow, or the chain's prefix was used up
        head = ~follows[todo] | np.r_[True, todo[1:] != todo[:-1] + 1]
        at = todo[head]
        shared[at] = _common(words, left, at, before[at])
        chain = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        start = todo[chain]
        rest = shared[start] - (todo - start)
        done = rest >= 0
        shared[todo[done]] = rest[done]
        todo = todo[~done]
    return before, shared


def repeated_starts(order: np.ndarray, shared: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Text positions whose string of ``length`` has two places or more:
    neighbours in ``order`` that share it are one string, and a position
    stands for ``copies`` places."""
    repeated = np.zeros(len(shared), bool)
    if len(order):
        head = np.flatnonzero(shared[order] < length)
        places = np.add.reduceat(copies[order], head)
        repeated[order] = np.repeat(places > 1, np.diff(np.r_[head, len(order)]))
    return repeated


def _shard(length: int, ranges: int):
    """Repeated starts of one shard, and fingerprints for other shards."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("bytes").to_pylist()
        size = np.array([len(p) for p in parts])
        text = np.frombuffer(b"".join(parts), np.uint8)
        row, first = table.column("row").to_numpy(), table.column("start").to_numpy()
        anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
        copies, hot = table.column("copies").to_numpy(), table.column("hot").to_numpy()
        end = np.cumsum(size)
        segment = np.repeat(np.arange(len(parts)), size)
        left = end[segment] - np.arange(len(text))
        order = suffix_array(text, left, length)
        order = order[left[order] >= length]
        _, shared = common_prefixes(text, left, order)
        repeated = repeated_starts(order, shared, copies[segment], length)
        offset = np.arange(len(text)) - (end - size)[segment]
        place = offset + first[segment]

        at = np.flatnonzero(repeated & (copies[segment] == 1))
        out = [("flag", -1, *_packed(*_runs(row[segment[at]], place[at])), None, None)]
        at = np.flatnonzero(repeated & (copies[segment] > 1))
        owner, start, count = _runs(segment[at], offset[at])
        out.append(("copies", -1, *_packed(anchor[owner], start, count), content[owner].tobytes(), None))
        one = order[shared[order] < length]  # one of each distinct string
        one = one[hot[segment[one]]]
        if len(one):
            h = _string_hash(text, one, one + length)
            known = repeated[one]
            by = (h >> np.uint64(32)).astype(np.int64) * ranges >> 32
            o = np.lexsort((h, by))
            for r in np.unique(by):
                x = o[np.searchsorted(by[o], r):np.searchsorted(by[o], r, side="right")]
                out.append(("string", int(r), row[segment[one[x]]].tobytes(), place[one[x]].tobytes(), b"",
                            h[x].tobytes(), known[x].tobytes()))
        cols = list(zip(*out))
        return pa.table([pa.array(c, k) for c, k in zip(cols, _SHARD_KINDS)], names=_SHARD_NAMES)

    return run


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of a row: rows, first starts, counts."""
    o = np.lexsort((start, row))
    row, start = row[o], start[o]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) \
        if len(row) else np.zeros(0, int)
    return row[head], start[head], np.diff(np.r_[head, len(row)])


def _packed(*columns: np.ndarray) -> tuple[bytes, ...]:
    return tuple(c.astype(np.int64).tobytes() for c in columns)


_SHARD_NAMES = ["kind", "range", "rows", "starts", "counts", "hashes", "known"]
_SHARD_KINDS = [pa.string(), pa.int64(), *[pa.binary()] * 5]
_SHARD = "kind string, range bigint, rows binary, starts binary, counts binary, hashes binary, known binary"


def _merge(table: pa.Table) -> pa.Table:
    """Strings of one fingerprint range that two shards or more have."""
    lists = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    rows = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("rows").to_pylist()])
    starts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("starts").to_pylist()])
    known = np.concatenate([np.frombuffer(x, bool) for x in table.column("known").to_pylist()])
    everything = np.sort(np.concatenate(lists))
    found = np.concatenate([np.searchsorted(everything, x, side="right") - np.searchsorted(everything, x)
                            for x in lists]) > 1
    at = np.flatnonzero(found & ~known)
    r, s, n = _packed(*_runs(rows[at], starts[at]))
    return pa.table({"rows": pa.array([r], pa.binary()), "starts": pa.array([s], pa.binary()),
                     "counts": pa.array([n], pa.binary())})


def _unpack(batches):
    """One row for each number of the packed columns."""
    for batch in batches:
        cols = [np.concatenate([np.frombuffer(x, np.int64) for x in c.to_pylist() if x]
                               + [np.zeros(0, np.int64)]) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], batch.schema.names)


def _cut(length: int):
    """The bytes of the segments of the texts of one bucket."""
    unit = place_unit(length)

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["row", "anchor", "content", "sub", "copies", "hot", "place"]
        row, anchor, content, sub, copies, hot, place = (wanted.column(n).to_pylist() for n in names)
        texts = {}
        if row:
            need = set(row)
            keys = docs.column("row").to_pylist()
            keep = [i for i, k in enumerate(keys) if k in need]
            texts = dict(zip((keys[i] for i in keep), texts_of(docs.take(pa.array(keep, pa.int64())))))
        start = [p // unit for p in place]
        cut = [texts[r][s:s + p % unit + length] for r, s, p in zip(row, start, place)]
        cols = [anchor, content, sub, row, start, copies, hot, cut]
        return pa.table([pa.array(c, k) for c, k in zip(cols, _CUT_KINDS)],
                        names=["anchor", "content", "sub", "row", "start", "copies", "hot", "bytes"])

    return run


_CUT_KINDS = [*[pa.int64()] * 6, pa.bool_(), pa.binary()]
_CUT = ("anchor bigint, content bigint, sub bigint, row bigint, start bigint, copies bigint, "
        "hot boolean, bytes binary")


def _apply(length: int):
    """Cuts the repeated strings out of the texts of one bucket."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        row, start, count = (flags.column(n).to_numpy() for n in ("row", "start", "count"))
        o = np.lexsort((start, row))
        row, start, count = row[o], start[o], count[o]
        keys = docs.column("row").to_numpy()
        lo, hi = np.searchsorted(row, keys), np.searchsorted(row, keys, side="right")
        size, removed, spans, kept = [], [], [], []
        for raw, a, b in zip(texts_of(docs), lo, hi):
            gone, pieces, at = [], [], 0
            for s, e in zip(start[a:b].tolist(), (start[a:b] + count[a:b] - 1 + length).tolist()):
                if gone and s <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], e)
                else:
                    gone.append([s, e])
            for s, e in gone:
                pieces.append(raw[at:s])
                at = e
            pieces.append(raw[at:])
            size.append(len(raw))
            removed.append(sum(e - s for s, e in gone))
            spans.append([{"start": s, "end": e} for s, e in gone])
            kept.append(b"".join(pieces))
        return pa.table([docs.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                         pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                        names=["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, removed, kept`` of every row: the maximal
    removed byte spans and the bytes left."""
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).cast("bigint").alias("id"),
                       text.alias("text"))
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * width, -(-total // APPLY_BYTES))

    def bucket(frame):
        return frame.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int"))

    # 1. segments
    found = scratch_table(rows.select("row", "text").mapInArrow(_find(length), _FOUND))
    distinct = found.groupBy("anchor", "content").agg(
        F.sum(F.size("rows")).alias("copies"),
        F.min(F.struct(F.col("rows")[0].alias("row"), F.col("places")[0].alias("place"))).alias("at"))
    shared = distinct.groupBy("anchor").agg(F.sum("copies").alias("places"), F.count("*").alias("n")) \
        .filter("places > 1").select("anchor", "n")
    shared = checkpoint(shared)

    # 2. shards; an anchor's segments have about the same size
    about = length * 3 // 2
    subs = F.ceil(F.col("n") * about / HOT_BYTES).cast("bigint")
    wanted = distinct.join(shared, "anchor").select(
        "anchor", "content", "at.row", "at.place", "copies", F.pmod("content", subs).alias("sub"),
        (subs > 1).alias("hot"))
    packed = rows.mapInArrow(compress_texts, "row bigint, id bigint, packed binary")
    cut = bucket(packed).groupBy("bucket").cogroup(bucket(wanted).groupBy("bucket")).applyInArrow(
        _cut(length), _CUT)
    sizes = shared.agg(F.sum("n").alias("n"), F.sum(F.when(subs > 1, F.col("n"))).alias("hot")).first()
    shards = max(2 * width, -(-(sizes["n"] or 0) * about // SHARD_BYTES))
    ranges = max(width, -(-(sizes["hot"] or 0) * about // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("anchor", "sub"), F.lit(shards)).cast("int")
    sharded = scratch_table(cut.withColumn("shard", shard).groupBy("shard").applyInArrow(
        _shard(length, ranges), _SHARD))

    # 3. merging
    merged = sharded.filter("kind = 'string'").groupBy("range").applyInArrow(
        _merge, "rows binary, starts binary, counts binary")
    runs = sharded.filter("kind = 'flag'").select("rows", "starts", "counts").unionByName(merged)
    flags = runs.select(F.col("rows").alias("row"), F.col("starts").alias("start"),
                        F.col("counts").alias("count")).mapInArrow(_unpack, "row bigint, start bigint, count bigint")

    # what was found on a segment holds at all its places
    unit = place_unit(length)
    copied = sharded.filter("kind = 'copies'").select(
        F.col("rows").alias("anchor"), F.col("hashes").alias("content"), F.col("starts").alias("start"),
        F.col("counts").alias("count")).mapInArrow(_unpack, "anchor bigint, content bigint, start bigint, count bigint")
    copied = found.join(copied, ["anchor", "content"]).select(
        "start", "count", F.inline(F.arrays_zip("rows", "places")).alias("row", "place"))
    flags = flags.unionByName(copied.select(
        "row", (F.floor(F.col("place") / unit).cast("bigint") + F.col("start")).alias("start"), "count"))
    return bucket(packed).groupBy("bucket").cogroup(bucket(flags).groupBy("bucket")).applyInArrow(
        _apply(length), "doc_id bigint, n_bytes bigint, n_removed bigint, "
                        "removed array<struct<start:bigint,end:bigint>>, kept binary")
