"""Registered queries of the corpus operators, with production parameters
over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import (byte_bpe, html_text, learned_partitions, mixing, quality_rules, rule_ensemble, secrets,
                         simhash, substring_dedup, suffix_dedup, token_alignment, toxicity, whitening)
from cadenza.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The two sides of the alignment.
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op1_mixing", r"""
with docs as materialized (
    select row_number() over () as rid, doc_id, source,
        md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as shuffle_key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
    from documents),
per as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (
    select *, row_number() over (order by source is null, encode(source)) - 1 as rnk,
        source_size * 2.0::double as cap, 1.5::double * sum(source_size) over () as budget
    from per),
weighed as (
    select *, case rnk % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight from ranked),
levels as (
    select *, cap / weight as level,
        (budget - coalesce(sum(cap) over (order by cap / weight, rnk
            rows between unbounded preceding and 1 preceding), 0))
        / sum(weight) over (order by cap / weight, rnk rows between current row and unbounded following) as rest
    from weighed),
filled as (select *, min(rest) filter (where rest < level) over () as any_rest,
    arg_min(rest, row(level, rnk)) filter (where rest < level) over () as final from levels),
per_source as (
    select source, source_size, rnk, budget,
        case when any_rest is null then cap else least(cap, final * weight) end as target
    from filled),
timed as (
    select d.rid, d.doc_id, d.size, d.shuffle_key, p.rnk, p.source_size, p.target, p.budget,
        sum(d.size) over (partition by p.rnk order by d.shuffle_key, d.size
            rows between unbounded preceding and current row) as cum
    from docs d join per_source p on d.source is not distinct from p.source),
entries as (
    select *, (cum + e * source_size) / nullif(target, 0) as finish from timed, (values (0), (1)) as p(e)
    where size > 0),
run as (
    select rid, size,
        sum(size) over (order by finish, shuffle_key, rnk rows between unbounded preceding and current row)
        - size / 2.0 <= budget as inside
    from entries),
took as (select rid, sum(case when inside then size else 0 end) as taken from run group by rid)
select t.doc_id, t.size, t.source_size::bigint as source_size, t.target, coalesce(k.taken, 0)::bigint as taken
from timed t left join took k on t.rid = k.rid
""")
def op1(spark, sf_dir):
    return mixing.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def _secrets_sql() -> str:
    def quoted(regex):
        return "'" + regex.replace("'", "''") + "'"

    patterns = [secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.ACCOUNT, secrets.OPAQUE, secrets.ENDPOINT]
    matches = " union all ".join(
        f"select rid, {i} as kind, string_split_regex(text, {quoted(p)}) as gaps, "
        f"regexp_extract_all(text, {quoted(p)}) as ms from docs" for i, p in enumerate(patterns))
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    counts = ", ".join(f"coalesce(sum((kind = {i})::int), 0)::bigint as n_{k}" for i, k in enumerate(secrets.KINDS))

    def near(kinds):
        return (f"exists (select 1 from parts o where o.rid = w.rid and o.kind in {kinds} and o.kind <> w.kind "
                f"and greatest(o.s, w.s) - least(o.e, w.e) <= {secrets.SCOPE})")

    return f"""
with docs as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as (select rid, kind, unnest(gaps[1:len(ms)]) as gap, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as pos
    from ({matches}) where len(ms) > 0),
placed as (select rid, kind, m, sum(length(gap) + length(m)) over (partition by rid, kind order by pos) as e from found),
parts as materialized (select rid, kind, e - length(m) as s, e from placed where case kind
    when 0 then length(regexp_extract(m, {quoted(secrets.ASSIGN)}, 2)) >= 12
    when 1 then length(m) >= 18
    when 2 then length(m) >= 16
    when 3 then length(regexp_extract(m, {quoted(secrets.ACCOUNT)}, 4)) >= 3
    when 4 then length(m) >= 20 and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')
        and regexp_matches(m, '[0-9]')
    else length(m) >= 10 end),
weak as materialized (select * from parts w where kind >= 3 and not exists (select 1 from parts o
    where o.rid = w.rid and o.kind < 3 and o.s <= w.s and w.e <= o.e)),
spans as (select * from parts where kind < 3
    union all select * from weak w where kind = 3 and {near("(0, 2, 4)")}
    union all select * from weak w where kind = 4 and {near("(1, 3)")}
    union all select * from weak w where kind = 5 and {near("(0, 2, 4)")} and {near("(1, 3)")}),
named as (select *, {names}[kind + 1] || ':' || s::bigint::varchar || ':' || e::bigint::varchar as span from spans),
per as (select rid, {counts},
    coalesce(string_agg(span, ',' order by s, kind) filter (where kind < 3), '') as base,
    coalesce(string_agg(span, ',' order by s, kind), '') as spans from named group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in secrets.KINDS)},
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join per using (rid)"""


@query("op2_secrets", _secrets_sql())
def op2(spark, sf_dir):
    return secrets.digest(secrets.report(table(spark, sf_dir, "documents")))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    out = byte_bpe.transcode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                             public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_rule_ensemble")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_learned_partitions")
def op6(spark, sf_dir):
    return learned_partitions.search_each_length(table(spark, sf_dir, "embeddings"), k=5, every=50)


@query("op7_toxicity")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


@query("op8_suffix_dedup")
def op8(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_substring_dedup", r"""
with docs as (select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as key,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (select rid, key, unnest(ws) as w, unnest(range(len(ws))) as pos from docs),
windows as (select *, list(w) over (partition by rid order by pos rows between current row and 12 following) as win
    from words),
first as (select *, len(win) = 13 and min(key) over (partition by win) < key as seen from windows),
marked as (select *, max(seen::int) over (partition by rid order by pos rows between 12 preceding and current row) as gone
    from first),
per as (select rid, sum(gone) as n_removed, string_agg(w, ' ' order by pos) filter (where gone = 0) as kept
    from marked group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from docs left join per using (rid)
""")
def op9(spark, sf_dir):
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_simhash")
def op10(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_token_alignment")
def op11(spark, sf_dir):
    return token_alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A),
                                 public_tokenizers.path(TOKENIZER_B))


@query("op12_html_text")
def op12(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.fit(spark))


@query("op13_whitening")
def op13(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
