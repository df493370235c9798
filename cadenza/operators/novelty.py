"""How many keys of an arriving file are new, without joining the history.

The history and every file keep a theta sketch of their keys: a sample of
at most ``2 ** size`` key hashes below a threshold. Sketches of many files
add up to the history's, and the difference of a file's sketch and the
history's estimates the file's new keys. While a sketch holds all its keys
the answer is exact; beyond, the estimate's standard error is that of a
sample of the keys below the smaller threshold (:func:`bound`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the hashes a sketch holds.
SIZE = 14
#: Standard errors that the bound allows.
SIGMAS = 4.0


def key_text(key: list[str]) -> Column:
    """A key of several columns as one text; null is a value of its own."""
    return F.to_json(F.struct(*(F.col(c).alias(c) for c in key)), {"ignoreNullFields": "false"})


def key_sketches(df: DataFrame, key: list[str], by: list[str], size: int = SIZE) -> DataFrame:
    """``n_rows, keys`` (a sketch) per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.theta_sketch_agg(key_text(key), F.lit(size)).alias("keys"))


def history_sketch(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """One sketch of all keys, from the sketches of files (``keys``)."""
    return sketches.agg(F.theta_union_agg("keys", F.lit(size)).alias("history"))


def new_keys(files: DataFrame, history: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """Per file ``n_keys`` and ``n_new`` by the sketches, and ``bound``, the
    error that the new keys' estimate stays within. ``history`` is the one
    row of :func:`history_sketch`."""
    rows = files.join(F.broadcast(history))  # one row on the right
    n_keys = F.theta_sketch_estimate("keys")
    union = F.theta_sketch_estimate(F.theta_union("keys", "history", F.lit(size)))
    n_new = F.theta_sketch_estimate(F.theta_difference("keys", "history"))
    return rows.select(*by, "n_rows", n_keys.alias("n_keys"), n_new.alias("n_new"), bound(n_new, union, size).alias("bound"))


def bound(n_new: Column, n_union: Column, size: int = SIZE) -> Column:
    """``SIGMAS`` standard errors: of m keys the sample holds each with the
    chance ``2 ** size / n_union``, so the estimate's variance is about
    ``m (n_union / 2 ** size)``. Zero while every key is held."""
    held = float(2 ** size)
    return F.when(n_union <= held, F.lit(0.0)).otherwise(
        F.lit(SIGMAS) * F.sqrt(F.greatest(n_new, F.lit(1.0)) * n_union / held) + n_union / held)
