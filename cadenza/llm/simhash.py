"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingle hashes
(XXH64, seed 42) have it set. Fingerprints are linked at ``DISTANCE`` or
fewer differing bits; linked documents form components.

Candidates follow the pigeonring principle: the 64 bits stand on a ring of
five segments, and a pair within distance 4 has a segment from which every
chain of l consecutive segments differs in at most 4 l / 5 bits, that is 0,
1, 2, 3 and 4. The first two budgets make the keys: a pair meets on a
segment that is equal and a next segment of which, cut in four parts, some
three parts are equal. Within a key the longer chains prune the pairs
before the Hamming check.

Copies are one fingerprint from the start. A key with more than ``BLOCK``
fingerprints is dealt into blocks, and every two blocks of it meet in a
tile of bounded size. A task returns no pairs but a spanning forest of the
links it has seen, at most one row for a fingerprint.

Defined results: words are lower-cased in A-Z; a null or empty text has
fingerprint zero, which is linked like any other; repeated rows are in one
component; a null id is never a component's id unless all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.components import components
from cadenza.session import checkpoint

DISTANCE = 4
SEED = 42
#: Ring segments as (first bit, bits); one more than the distance.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Fingerprints of one key that meet in one tile.
BLOCK = 1024
#: Rows of tiles that one group is meant to get; the groups grow with the rows.
GROUP_ROWS = 200_000
ROWS = 256


def shingles(text: str | None, width: int) -> list[bytes]:
    """The shingles of a text, with repeats."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    return [joined[a:b - 1] for a, b in zip([0, *ends], ends[width - 1:])]


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit over unsigned 64-bit hashes, as a signed value."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], width: int = 4, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp`` (bigint) of every row."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        from xxhash import xxh64_intdigest as xxh64
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                fps = [fingerprint(np.array([xxh64(s, SEED) for s in shingles(t.as_py(), width)], np.uint64))
                       for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(j) for j in range(len(keep))] + [pa.array(fps, pa.int64())], [*keep, "fp"])

    return docs.select(*keep, text_col).mapInArrow(run, f"{kinds}, fp bigint")


def _keys() -> tuple[np.ndarray, list[int]]:
    """Masks of the key bits, and the start segment of each."""
    masks, starts = [], []
    for i, (lo, bits) in enumerate(SEGMENTS):
        own = ((1 << bits) - 1) << lo
        lo2, bits2 = SEGMENTS[(i + 1) % len(SEGMENTS)]
        edges = [bits2 * q // 4 for q in range(5)]
        for skip in range(4):
            kept = sum(((1 << (edges[q + 1] - edges[q])) - 1) << (lo2 + edges[q])
                       for q in range(4) if q != skip)
            masks.append(own | kept)
            starts.append(i)
    return np.array(masks, np.uint64), starts


MASKS, STARTS = _keys()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether differences ``x`` keep all chain budgets from ring segment
    ``start``, and with them the distance."""
    per = [np.bitwise_count(x & np.uint64(((1 << bits) - 1) << lo)) for lo, bits in SEGMENTS]
    per = np.stack(per).astype(np.int8)
    at, total = np.arange(len(x)), np.zeros(len(x), np.int16)
    ok = np.ones(len(x), bool)
    n = len(SEGMENTS)
    for length in range(1, n + 1):
        total += per[(start + length - 1) % n, at]
        ok &= total <= DISTANCE * length // n
    return ok


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) rows that connect what the links (a, b) connect."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links(table: pa.Table) -> pa.Table:
    """Links within the tiles of one group, as a spanning forest."""
    fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    tile = table.column("tile").to_numpy()
    kind = table.column("k").to_numpy().astype(np.int64)
    order = np.lexsort((fp, tile, kind))
    fp, tile, kind = fp[order], tile[order], kind[order]
    start = np.array(STARTS)[kind]
    a, b = [], []
    at = np.arange(len(fp))
    step = 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[(tile[at] == tile[at + step]) & (kind[at] == kind[at + step])]
        for i in range(0, len(at), 1 << 18):
            x = at[i:i + (1 << 18)]
            hit = x[near(fp[x] ^ fp[x + step], start[x])]
            a.append(fp[hit])
            b.append(fp[hit + step])
        step += 1
    none = np.zeros(0, np.uint64)
    node, root = forest(np.concatenate([none, *a]), np.concatenate([none, *b]))
    return pa.table({"a": pa.array(node.view(np.int64)), "b": pa.array(root.view(np.int64))})


def group_count(rows: int, spark: SparkSession) -> int:
    """Groups for so many rows of tiles: each gets about ``GROUP_ROWS``,
    and every shuffle partition has some."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // GROUP_ROWS))


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` within
    the distance (a spanning forest of every task's links)."""
    masks = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(_signed(int(m))).alias("mask"))
                      for i, m in enumerate(MASKS)))
    keyed = fps.select("fp", F.explode(masks).alias("m")) \
        .select("fp", "m.k", F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
    counted = keyed.groupBy("k", "key").agg(F.count("*").alias("n"))
    hot = checkpoint(counted.filter(F.col("n") > BLOCK)
                     .select("k", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"))
    # a hot key's rows go to each of its blocks
    more = hot.agg(F.sum(F.col("n") * (F.col("blocks") - 1)).alias("n")).first()["n"] or 0
    groups = group_count(fps.count() * len(MASKS) + int(more), fps.sparkSession)
    if hot.isEmpty():
        tiled = keyed.withColumn("tile", F.xxhash64("key", "k"))
    else:
        rows = keyed.join(hot.drop("n"), ["k", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiled = rows.withColumn("tile", F.xxhash64(
            "key", "k", F.least("own", F.col("other").cast("bigint")), F.greatest("own", F.col("other").cast("bigint"))))
    tiled = tiled.select("fp", "k", "tile", F.pmod("tile", F.lit(groups)).cast("int").alias("grp"))
    return tiled.groupBy("grp").applyInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", keep: list[str] | None = None,
                    text_col: str = "text", root_col: str | None = None) -> DataFrame:
    """``keep`` (default: the id), ``fp`` and ``component_id``, the smallest
    id of the row's component; with ``root_col`` also the component's root, a
    fingerprint, under that name. Components may share an id, never a root."""
    keep = keep or [id_col]
    rows = checkpoint(fingerprints(docs, keep, width, text_col))
    distinct = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = checkpoint(named)
    lowest = checkpoint(named.groupBy("root").agg(F.min("low").alias("component_id")))
    roots_too = [root_col] if root_col else []
    of = named.join(lowest, "root").select("fp", "component_id", *(F.col("root").alias(c) for c in roots_too))
    of = checkpoint(of)
    return rows.join(of, "fp").select(*keep, "fp", "component_id", *roots_too)


def keep_one(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every component: the one of the smallest id,
    then of the smallest text hash."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = near_duplicates(docs.withColumn("__key", key), width, id_col, [id_col, "__key"], text_col, "__root")
    # by root: components may share their smallest id, or have none
    first = rows.groupBy("__root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("last"), F.col(id_col).alias("i"), F.col("__key").alias("k"))).alias("w"))
    first = checkpoint(first.select(F.coalesce(F.concat(F.lit("d"), F.col("w.i").cast("string")), F.lit(""))
                                    .alias("__doc"), F.col("w.k").alias("__key")).distinct())
    doc = F.coalesce(F.concat(F.lit("d"), F.col(id_col).cast("string")), F.lit(""))
    columns = docs.columns
    keyed = docs.withColumn("__key", key).withColumn("__doc", doc)
    return keyed.join(first, ["__doc", "__key"], "left_semi").dropDuplicates(["__doc", "__key"]) \
        .select(*(F.col(f"`{c}`") for c in columns))
