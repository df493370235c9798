"""Bounded, repeatable samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import checkpoint


def held_out(id_col: str = "doc_id"):
    """Rows no model may learn from: crc32 of the id as text is 0 modulo 5
    (a null id counts as the empty text)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


def sample(labels: DataFrame, label: str, rows: int, learn=None, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids of each class (0 and 1), those of the
    smallest id hash, as ``id_col, y, weight``; the weight restores the
    classes' shares among all labels. One row per id, the larger label."""
    found = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    if learn is not None:
        found = found.filter(learn)
    found = found.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    found = checkpoint(found, gather=True)
    sizes = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    out = None
    for y, n in sorted(sizes.items()):
        part = found.filter(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(rows) \
            .withColumn("weight", F.lit(n / min(n, rows)))
        out = part if out is None else out.unionByName(part)
    return checkpoint(out if out is not None else found.withColumn("weight", F.lit(1.0)), gather=True)
