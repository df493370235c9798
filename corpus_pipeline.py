"""Corpus pipeline: toxic documents go, one document of each group of near
duplicates stays, secrets are masked, sources are mixed to their weights,
and the mix is encoded and decoded.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read back for the next one. All
but the last return the columns of ``documents``. The toxicity stage learns
from the ``labels`` table. A document taken twice by the mix is there
twice.

Defined results: a null text is empty; without labels of both classes
nothing is toxic; empty texts are near duplicates of each other; rows with a
null id take part like any other; texts of any length are handled whole;
repeated rows are exact copies, of which one stays; extra columns stay as
they are up to the last stage, whatever their names; no documents give no
rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, mixing, secrets, simhash, toxicity
from cadenza.session import scratch_table
from cadenza.tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that of the
    smallest id."""
    return simhash.keep_one(docs, width=4)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of secrets and linked
    credentials."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, number of tokens, tokens, and the digest of what they decode to,
    of every document."""
    out = byte_bpe.transcode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic),
          ("simhash near-dedup", drop_near_duplicates),
          ("secret scans", mask_secrets),
          ("mixing", mix_sources),
          ("byte-level BPE", encode)]

#: Model fits and 64-bit hashes have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch_table(docs)
    return docs
