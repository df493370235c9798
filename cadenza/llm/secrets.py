"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong findings are told by their own form: an assignment to a secret name,
an access identifier, a long run of hex digits. Weak candidates (an account
name, an opaque mixed token, an endpoint) say little by themselves; they
are reported only when the parts that complete a credential stand within
their scope, the ``SCOPE`` code points around them. That is an interval
join: parts are dealt into bins of the document, and a candidate meets the
parts of its bins in a left semi join on the gap, so no pair is emitted.

Regular expressions give matches and the pieces between them; their
lengths become rows whose running sum is the position of each match. Texts
themselves are never shuffled by the scan.

Defined results: positions count code points, ends are exclusive; a null
or empty text has no spans; rows with the same id and text share their
spans; a null id is an id; extra columns are ignored (``redact`` keeps
them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import checkpoint

#: Kinds in their order; the first three are strong.
KINDS = ["assign", "access", "hex", "account", "opaque", "endpoint"]
ASSIGN = (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"
          r"[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ACCOUNT = (r"([Uu][Ss][Ee][Rr]_?([Nn][Aa][Mm][Ee]|[Ii][Dd])?|[Ll][Oo][Gg][Ii][Nn]|"
           r"[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?([Ii][Dd])?)"
           r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""")
OPAQUE = r"[A-Za-z0-9/+_-]+"
ENDPOINT = r"""[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D"'<>]+"""
LEAST = {"assign": 12, "access": 18, "hex": 16, "account": 3, "opaque": 20, "endpoint": 10}
#: Code points between a weak candidate and a part that completes it; also
#: the width of a bin.
SCOPE = 200
#: Tables of findings are broadcast up to this many spans, in all rows.
BROADCAST_SPANS = 100_000
MASK = "[REDACTED]"


def _found(text: Column, regex: str, ok) -> Column:
    """Lengths of (piece before, match) for every match in order, and
    whether the match counts; the rest of the text is left out."""
    lengths = F.transform(F.split(text, regex, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return F.zip_with(F.slice(lengths, 1, F.size(matches)), matches,
                      lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("len"), ok(m).alias("ok")))


def _scan(text: Column) -> dict[str, Column]:
    """Columns by kind: arrays of matches. Patterns that only keep long runs
    ask for the length at once; the runs are the same."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")

    def if_any(guard, regex, ok):
        return F.when(guard, _found(text, regex, ok)).otherwise(none)

    def always(m):
        return F.lit(True)

    # a run starts where no run character stands before it
    hexes = r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST["hex"]
    opaque = r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{%d,}" % LEAST["opaque"]
    access = r"AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4)

    def value(regex, group, least):
        return lambda m: F.length(F.regexp_extract(m, regex, group)) >= least

    def mixed(m):
        return m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")

    return {
        "assign": if_any(text.rlike(ASSIGN), ASSIGN, value(ASSIGN, 2, LEAST["assign"])),
        "access": if_any(text.contains("AKIA"), access, always),
        "hex": if_any(text.rlike(hexes), hexes, always),
        "account": if_any(text.rlike(ACCOUNT), ACCOUNT, value(ACCOUNT, 4, LEAST["account"])),
        "opaque": if_any(text.rlike(opaque), opaque, mixed),
        "endpoint": if_any(text.contains("://"), ENDPOINT, lambda m: F.length(m) >= LEAST["endpoint"]),
    }


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text_key`` and an array of matches by kind, one row per
    row of ``docs``."""
    text = F.col(text_col)
    return docs.select(F.col(id_col), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
                       *(c.alias(k) for k, c in _scan(text).items()))


def spans(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc, text_key, kind (number), start, end``: strong findings and
    linked weak candidates of every distinct (id, text). A candidate that a
    strong finding covers wholly is left out."""
    hit = F.lit(False)
    for k in KINDS:
        hit = hit | (F.size(k) > 0)
    doc = F.concat(F.lit("d"), F.col(id_col).cast("string"))
    rows = scanned.filter(hit).select(F.coalesce(doc, F.lit("")).alias("doc"), "text_key", *KINDS)
    rows = rows.dropDuplicates(["doc", "text_key"])
    each = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("found")) for i, k in enumerate(KINDS)))
    rows = rows.select("doc", "text_key", F.explode(each).alias("k")) \
        .select("doc", "text_key", "k.kind", F.posexplode("k.found").alias("at", "m"))
    upto = Window.partitionBy("doc", "text_key", "kind").orderBy("at") \
        .rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("bigint") + F.col("m.len")).over(upto)
    parts = rows.select("doc", "text_key", "kind", "m.ok", end.alias("end"),
                        (end - F.col("m.len")).alias("start")).filter("ok").drop("ok")
    parts = checkpoint(parts)
    strong = parts.filter(F.col("kind") < 3)
    return strong.unionByName(_linked(parts))


def _bins(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / SCOPE).cast("bigint"), F.floor(hi / SCOPE).cast("bigint")))


def _linked(parts: DataFrame) -> DataFrame:
    """Weak candidates with their complement in scope and no strong finding
    over the whole of them. Identifiers are access keys and accounts, secrets
    are assignments, hex runs and opaque tokens."""
    key = ["doc", "text_key"]

    def within(candidates, kinds, gap):
        reach = max(gap, 0)
        offer = parts.filter(F.col("kind").isin(*kinds)).select(
            *key, F.col("start").alias("s"), F.col("end").alias("e"), F.col("kind").alias("other")) \
            .withColumn("bin", _bins(F.col("s"), F.col("e")))
        seek = candidates.withColumn("bin", _bins(F.greatest(F.col("start") - reach, F.lit(0)),
                                                  F.col("end") + reach))
        space = F.greatest("start", "s") - F.least("end", "e")
        return seek, offer, space

    def near(candidates, kinds):
        seek, offer, space = within(candidates, kinds, SCOPE)
        return seek.join(offer, [*(seek[c] == offer[c] for c in [*key, "bin"]),
                                 seek["kind"] != offer["other"], space <= SCOPE], "left_semi") \
            .drop("bin").dropDuplicates([*key, "kind", "start"])

    def apart(candidates, kinds):
        seek, offer, _ = within(candidates, kinds, 0)
        hidden = (F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e"))
        over = seek.join(offer, [*(seek[c] == offer[c] for c in [*key, "bin"]), hidden], "left_semi") \
            .select(*key, "kind", "start").distinct()
        return candidates.join(over, [*key, "kind", "start"], "left_anti")

    identifiers, secrets = (1, 3), (0, 2, 4)
    weak = apart(parts.filter(F.col("kind") >= 3), (0, 1, 2))
    account = near(weak.filter("kind = 3"), secrets)
    opaque = near(weak.filter("kind = 4"), identifiers)
    endpoint = near(near(weak.filter("kind = 5"), secrets), identifiers)
    return account.unionByName(opaque).unionByName(endpoint)


def _joined(kinds: Column, keep) -> Column:
    """``kind:start:end`` of the kept spans by start, then kind."""
    rows = F.array_sort(F.filter(kinds, keep))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(rows, lambda r: F.concat_ws(
        ":", F.element_at(names, r["kind"] + 1), r["start"].cast("string"), r["end"].cast("string"))), ",")


def _spans_in(per: DataFrame, col: str) -> int:
    """Spans in the arrays of a table, each with at least one."""
    return per.agg(F.sum(F.size(col))).first()[0] or 0


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``found``, an array of
    (start, kind, end)."""
    scanned = checkpoint(scan(docs, id_col, text_col))
    per = spans(scanned, id_col).groupBy("doc", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    per = checkpoint(per)
    doc = F.coalesce(F.concat(F.lit("d"), F.col(id_col).cast("string")), F.lit(""))
    rows = scanned.select(id_col, doc.alias("doc"), "text_key")
    small = F.broadcast(per) if _spans_in(per, "found") <= BROADCAST_SPANS else per
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(small, ["doc", "text_key"], "left").select(
        id_col, F.coalesce("found", none).alias("found"))


def digest(reported: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and span strings of a report."""
    found = F.col("found")

    def number(i):
        return F.size(F.filter(found, lambda r: r["kind"] == i)).cast("bigint")

    count = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return reported.select(id_col, *count,
                           F.sha2(_joined(found, lambda r: r["kind"] < 3), 256).alias("base_sha256"),
                           _joined(found, lambda r: F.lit(True)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``MASK``,
    also the linked weak candidates that a strong finding covers only in
    part: the rest of a credential does not stay. Overlapping spans become
    one. Rows and other columns stay."""
    scanned = checkpoint(scan(docs, id_col, text_col))
    key = ["doc", "text_key"]
    by = Window.partitionBy(*key).orderBy("start", F.desc("end"))
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans(scanned, id_col).withColumn("before", before)
    fresh = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    rows = rows.withColumn("run", F.sum(fresh).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = rows.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = checkpoint(cuts.withColumnsRenamed({"doc": "__doc", "text_key": "__text_key", "cuts": "__cuts"}))
    small = F.broadcast(cuts) if _spans_in(cuts, "__cuts") <= BROADCAST_SPANS else cuts
    text = F.col(text_col)
    doc = F.coalesce(F.concat(F.lit("d"), F.col(id_col).cast("string")), F.lit(""))
    on = (doc == F.col("__doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__text_key"))
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("__cuts", lambda c: c["end"]))
    starts = F.concat(F.transform("__cuts", lambda c: c["start"]), F.array(F.length(text).cast("bigint")))
    pieces = F.zip_with(edges, starts, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    new = F.when(F.col("__cuts").isNull(), text).otherwise(F.array_join(pieces, MASK))
    # a column of its own first: within one select the new text would be
    # taken for the old one
    joined = docs.join(small, on, "left").withColumn("__new", new)
    columns = {text_col: F.col("__new")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(
            F.length("__new").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))
