"""Mixing sources to target weights by weighted fair queueing.

Each source has a weight; together they share a budget of words. Every
document has a place in a shuffled order of its source, the same on every
run. Its virtual finish time is the words of its source up to and
including it, divided by the source's target. A second pass over the
source goes on from there, up to ``repeats`` passes. All (document, pass)
entries are put in one global order of finish time, and the order is cut
where the running total of words reaches the budget.

Running totals never take one task for a source: a source's documents are
dealt into ranges of their shuffle key, in number by the source's
documents; a range is summed by itself and starts at the total of the
ranges before it. The global order is ranged by finish time the same way;
the range in which the budget falls is cut again until it holds at most
``EDGE_ROWS`` entries, and only these are looked at row by row. The shuffle
key is made of id and text, so rows without an id are dealt like others.

Defined results: a null or empty text has size 0 and is never taken; a
null source is a source, the last; repeated rows are separate documents; an
empty table gives an empty mix; extra columns are kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Per-source and per-range totals are broadcast up to this many rows, and
#: shuffled beyond it.
BROADCAST_ROWS = 100_000
#: Ranges of virtual finish time, over the times up to 1, and of a range that
#: holds more entries than one task is to sort; the finest are 4096^-4 wide.
TIME_RANGES = 4096
EDGE_ROWS, EDGE_LEVELS = 100_000, 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source: its documents, words, weight and target.

    ``sizes`` has ``source, size``. The budget of ``share`` times all words
    is shared by weight; a target stops at ``repeats`` times its source's
    words and the excess is shared anew. Sources in order of the level at
    which they fill up; those full at the final level are capped there.
    This works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    per = per.withColumn("rank", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)),
                                                (F.col("rank") % len(weights) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(repeats))
    per = (per.withColumn("cap", full).withColumn("level", F.col("cap") / F.col("weight"))
           .withColumn("budget", F.lit(share) * F.sum("source_size").over(every)))
    by = Window.orderBy("level", "rank")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source and all later ones are not full
    rest = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("rest", rest)
    fits = F.min(F.when(F.col("rest") < F.col("level"), F.struct("level", "rank", "rest"))).over(every)
    per = per.withColumn("final", fits["rest"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return per.select("source", "rank", "n_docs", "source_size", "weight", target.alias("target"))


def _meet(rows: DataFrame, small: DataFrame, on) -> DataFrame:
    """Join with a table of totals: broadcast while it has few rows; beyond
    that a shuffle join, whose skewed partitions AQE splits."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on)


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2, seed: str = "mix",
         id_col: str = "doc_id", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` (default: id and source), ``size, source_size, target, taken``
    and ``finish`` (virtual time of the first pass) of every row."""
    keep = keep or [id_col, "source"]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                         F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.withColumn("size", size_of(F.col(text_col))).select(*keep, "size", key.alias("shuffle_key"))
    rows = checkpoint(rows)
    # null-safe joins on the source: a key column that is never null
    source = F.concat(F.lit("s"), F.col("source"))
    per = targets(rows, weights, share, repeats)
    per = checkpoint(per.select(F.coalesce(source, F.lit("")).alias("_s"), "rank", "n_docs",
                                "source_size", "target"), gather=True)
    budget = per.agg(F.sum("target")).first()[0]

    # ranges of the shuffle key: as many as the root of the source's documents,
    # so that neither a range nor the list of ranges gets long
    timed = _meet(rows.withColumn("_s", F.coalesce(source, F.lit(""))), per, "_s")
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    ranges = F.ceil(F.sqrt(F.col("n_docs"))).cast("bigint")
    timed = timed.withColumn("range", F.floor(place * ranges / 4294967296).cast("bigint"))
    totals = timed.groupBy("rank", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint(totals.select("rank", "range",
                                      F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead")), gather=True)
    timed = _meet(timed, starts, ["rank", "range"])
    within = Window.partitionBy("rank", "range").orderBy("shuffle_key", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    timed = timed.repartition("rank", "range") \
        .withColumn("cum", F.col("ahead") + F.sum("size").over(within))
    finish = [(F.col("cum") + e * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
              for e in range(repeats)]
    timed = checkpoint(timed.select(*keep, "size", "source_size", "target", "shuffle_key", "rank",
                                    *(f.alias(f"finish{e}") for e, f in enumerate(finish))))
    cut = _cut(timed, repeats, budget) if budget else None
    taken = F.lit(0)
    for e in range(repeats if cut else 0):
        taken = taken + F.when(F.coalesce(_upto(F.col(f"finish{e}"), cut), F.lit(False)),
                               F.col("size")).otherwise(F.lit(0))
    return timed.select(*keep, "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                        F.col("finish0").alias("finish"))


def _cut(timed: DataFrame, repeats: int, budget: float):
    """(finish, shuffle_key, rank) of the last entry within the budget."""
    entries = timed.filter(F.col("size") > 0).select(
        "size", "shuffle_key", "rank", F.explode(F.array(*(f"finish{e}" for e in range(repeats)))).alias("finish"))
    rows, start, ahead = entries, 0.0, 0
    for level in range(EDGE_LEVELS):
        # the targets together are the budget, so the cut is near time 1
        slot = F.floor((F.col("finish") - start) * float(TIME_RANGES)**(level + 1))
        slotted = rows.withColumn("slot", F.least(slot, F.lit(2 * TIME_RANGES)).cast("bigint"))
        slots = slotted.groupBy("slot").agg(F.sum("size").alias("slot_size"), F.count("*").alias("n"))
        upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.withColumn("ahead", F.lit(ahead) + F.coalesce(F.sum("slot_size").over(upto), F.lit(0)))
        last = slots.filter(F.col("ahead") <= budget).agg(F.max(F.struct("slot", "ahead", "n"))).first()[0]
        if last is None:
            return None
        rows, ahead = slotted.filter(F.col("slot") == last["slot"]).drop("slot"), last["ahead"]
        start += last["slot"] / float(TIME_RANGES)**(level + 1)
        if last["n"] <= EDGE_ROWS or last["slot"] == 2 * TIME_RANGES:
            break
    order = ["finish", "shuffle_key", "rank"]
    running = ahead + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    # an entry is in when at least half of it is within the budget
    within = rows.withColumn("running", running).filter(F.col("running") - F.col("size") / 2 <= budget)
    found = within.agg(F.max(F.struct(*order))).first()[0]
    if found is None:  # the first entry of the range is out already
        first = rows.agg(F.min(F.struct(*order))).first()[0]
        before = F.struct(*order) < F.struct(*(F.lit(first[c]).alias(c) for c in order))
        found = entries.filter(before).agg(F.max(F.struct(*order))).first()[0]
    return found


def _upto(finish: Column, cut) -> Column:
    key, rank = F.col("shuffle_key"), F.col("rank")
    return (finish < cut["finish"]) | ((finish == cut["finish"]) & (
        (key < cut["shuffle_key"]) | ((key == cut["shuffle_key"]) & (rank <= cut["rank"]))))


def mix(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixed rows of ``docs``, with all their columns; a document taken
    twice is there twice. Rows equal in all columns are interchangeable."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    values = [x for c in columns for x in (c, c.isNull())]
    own_id = F.coalesce(F.concat(F.lit("d"), F.col(id_col).cast("string")), F.lit(""))
    keyed = docs.withColumns({"__id": own_id, "__row": F.xxhash64(*values)})
    chosen = plan(keyed, id_col=id_col, keep=[id_col, "source", "__id", "__row"], **how)
    passes = chosen.filter(F.col("taken") > 0).groupBy("__id", "__row") \
        .agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("__passes"))
    rows = keyed.dropDuplicates(["__id", "__row"]).join(passes, ["__id", "__row"])
    return rows.withColumn("__pass", F.explode(F.sequence(F.lit(1), "__passes"))).select(*columns)
