"""Keyed merge operators: dedupe, upsert, batched upsert, file ledger.

Winner selection is ``min_by``/``max_by`` of a row struct over a total
order struct inside ``groupBy(key)``. Spark runs it as a sort aggregate
with a partial (map-side) step: each input task keeps one candidate per
key, so a key repeated across a third of the input is reduced before the
shuffle and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.ordinal import ordinal


def _order_struct(order: list) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def _pick(df: DataFrame, key: list[str], order: list, latest: bool) -> DataFrame:
    payload = [c for c in df.columns if c not in key]
    pick = F.max_by if latest else F.min_by
    return (df.groupBy(*key)
            .agg(pick(F.struct(*payload), _order_struct(order)).alias("_w"))
            .select(*key, "_w.*"))


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order`` (first in batch wins)."""
    return _pick(df, key, order, latest=False)


def duplicate_report(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows, distinct keys and the number of rows a dedupe removes."""
    by = by or []
    per_key = df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("_n"))
    return (per_key.groupBy(*by)
            .agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"))
            .withColumn("n_removed", F.col("n_rows") - F.col("n_unique")))


def latest_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the last by ``order``."""
    return _pick(df, key, order, latest=True)


def upsert_latest(target: DataFrame, updates: DataFrame, key: list[str], order: list,
                  identity: list[str] = ()) -> DataFrame:
    """Upsert as "latest row per key wins" over the union of both sides;
    ``identity`` columns stay those of the key's first row."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    if not identity:
        return _pick(rows, key, order, latest=True)
    payload = [c for c in rows.columns if c not in key and c not in identity]
    by = _order_struct(order)
    return (rows.groupBy(*key)
            .agg(F.max_by(F.struct(*payload), by).alias("_w"), F.min_by(F.struct(*identity), by).alias("_i"))
            .select(*key, "_i.*", "_w.*"))


def upsert_merge(target: DataFrame, updates: DataFrame, key: list[str],
                 identity: list[str], payload: list[str], stamp: str) -> DataFrame:
    """Full outer merge of two keyed tables (one row per key each): a
    matched row keeps its identity columns and takes the update's payload
    and time stamp; unmatched rows pass through."""
    t = target.select(*key, F.lit(True).alias("_t"),
                      *[F.col(c).alias(f"_t_{c}") for c in identity + payload + [stamp]])
    u = updates.select(*key, F.lit(True).alias("_u"),
                       *[F.col(c).alias(f"_u_{c}") for c in identity + payload + [stamp]])
    j = t.join(u, key, "full_outer")
    matched_u = F.col("_u").isNotNull()
    cols = [*key]
    cols += [F.coalesce(F.col(f"_t_{c}"), F.col(f"_u_{c}")).alias(c) for c in identity]
    cols += [F.when(matched_u, F.col(f"_u_{c}")).otherwise(F.col(f"_t_{c}")).alias(c)
             for c in payload + [stamp]]
    cols += [F.when(F.col("_t").isNull(), "insert")
             .when(matched_u, "update").otherwise("keep").alias("action")]
    return j.select(*cols)


def upsert_batched(rows: DataFrame, key: list[str], file_col: str, order: list[str],
                   batch_size: int = 100, file_order: str | None = None) -> DataFrame:
    """Exact sequence semantics of a row loop that writes in batches:
    files are processed in ``file_order`` (default: file name), rows in
    ``order`` inside a file, cut into batches of ``batch_size``; inside a
    batch the first row of a key wins, a later batch overwrites.

    Equivalent closed form: the winner of a key is the row with the
    greatest (file position, batch number) and, inside that batch, the
    smallest row position."""
    numbered = store_batches(rows, file_col, order, batch_size)
    return last_batch_first_row(numbered, key, file_col, file_order).drop("store_batch")


def store_batches(rows: DataFrame, file_col: str, order: list[str], batch_size: int = 100) -> DataFrame:
    """Adds ``row_in_file`` (from 1) and ``store_batch`` (from 0)."""
    numbered = ordinal(rows, [file_col], order, name="row_in_file")
    return numbered.withColumn("store_batch", F.floor((F.col("row_in_file") - 1) / batch_size))


def last_batch_first_row(numbered: DataFrame, key: list[str], file_col: str,
                         file_order: str | None = None) -> DataFrame:
    """Of every key the first row of its last batch, in file order."""
    rank = F.struct(F.col(file_order or file_col).alias("f"), F.col("store_batch").alias("b"),
                    (-F.col("row_in_file")).alias("r"))
    payload = [c for c in numbered.columns if c not in key]
    return (numbered.groupBy(*key)
            .agg(F.max_by(F.struct(*payload), rank).alias("_w"))
            .select(*key, "_w.*"))


# --- file ledger -------------------------------------------------------------
def latest_ledger(ledger: DataFrame, name_col: str = "filename",
                  order: list | None = None) -> DataFrame:
    """The last ledger entry per file name wins."""
    order = order or ["processed_at"]
    return _pick(ledger, [name_col], order, latest=True)


def new_files(current: DataFrame, ledger: DataFrame, name_col: str = "filename",
              fp_col: str = "fingerprint", order: list | None = None) -> DataFrame:
    """Listed files that are not in the ledger or carry another fingerprint."""
    last = latest_ledger(ledger.select(name_col, fp_col, *(order or ["processed_at"])),
                         name_col, order).select(name_col, fp_col)
    return current.join(last, [name_col, fp_col], "left_anti")


def ledger_entries(results: DataFrame, file_col: str, stored_col: str,
                   fingerprint: Column | None = None,
                   processed_at: Column | None = None) -> DataFrame:
    """Ledger rows (file, stored-row count) only for files with at least
    one stored row; ``stored_col`` marks the rows that were written."""
    aggs = [F.count_if(F.col(stored_col)).alias("successful_records")]
    if fingerprint is not None:
        aggs.append(F.max(fingerprint).alias("fingerprint"))
    out = results.groupBy(F.col(file_col).alias("filename")).agg(*aggs).filter(
        F.col("successful_records") > 0)
    return out.withColumn("processed_at", processed_at if processed_at is not None
                          else F.current_timestamp())
