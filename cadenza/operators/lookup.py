"""Name lookups against a catalogue: membership, first occurrence, result
or error per request, and category validity.

Requests are deduplicated first (repeats collapse to one key). The
catalogue side is reduced to one row per name by a partial aggregate
(``min_by``), so a name repeated a billion times costs one row per input
task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.schema import EMPTY_CATEGORY_TOKENS, NOT_FOUND


def name_exists(requests: DataFrame, catalogue: DataFrame, name_col: str,
                req_col: str = "request") -> DataFrame:
    """Requests whose name occurs in the catalogue (left semi join)."""
    return requests.join(catalogue.select(F.col(name_col).alias(req_col)), req_col, "left_semi")


def first_by_name(catalogue: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """One row per name: the first occurrence by ``order_col``."""
    others = [c for c in catalogue.columns if c != name_col]
    return (catalogue.groupBy(name_col)
            .agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(name_col, "_r.*"))


def lookup_first(requests: DataFrame, catalogue: DataFrame, name_col: str,
                 order_col: str, req_col: str = "request") -> DataFrame:
    """Inner lookup: each distinct request with its first catalogue row."""
    asked = requests.select(req_col).distinct()
    first = first_by_name(_asked_rows(catalogue, name_col, asked, req_col), name_col, order_col)
    return asked.join(first, F.col(req_col) == F.col(name_col), "inner")


def _asked_rows(catalogue: DataFrame, name_col: str, asked: DataFrame, req_col: str) -> DataFrame:
    """Catalogue rows of requested names, before anything is aggregated: a
    request list that proves small at run time is broadcast, and the rest of
    the catalogue is never shuffled."""
    return catalogue.join(asked, F.col(name_col) == F.col(req_col), "left_semi")


def lookup_or_error(requests: DataFrame, catalogue: DataFrame, name_col: str,
                    order_col: str, result_cols: list[str], req_col: str = "request",
                    error_text: str = NOT_FOUND, display_fill: str | None = None) -> DataFrame:
    """Every distinct request with its result columns, or an error text
    when the name is unknown (left outer join). ``display_fill`` (e.g.
    "N/A") renders every result column as text with missing values
    filled, for display tables."""
    asked = requests.select(req_col).distinct()
    rows = catalogue.select(name_col, order_col, *result_cols)
    first = first_by_name(_asked_rows(rows, name_col, asked, req_col), name_col, order_col)
    j = asked.join(first, F.col(req_col) == F.col(name_col), "left")
    found = F.col(name_col).isNotNull()
    shown = [F.col(c) for c in [order_col] + result_cols]
    if display_fill is not None:
        shown = [F.coalesce(c.cast("string"), F.lit(display_fill)).alias(n)
                 for c, n in zip(shown, [order_col] + result_cols)]
    return j.select(req_col, found.alias("found"), *shown,
                    F.when(found, F.lit(None).cast("string")).otherwise(F.lit(error_text)).alias("error"))


def category_tokens(catalogue: DataFrame, col: str, sep: str = r",\s*") -> DataFrame:
    """Distinct lower-case tokens of a list-valued text column ("pop, rock")."""
    toks = F.transform(F.split(F.lower(F.col(col)), sep), lambda t: F.trim(t))
    return (catalogue.select(F.explode(toks).alias("token"))
            .filter((F.length("token") > 0) & ~F.col("token").isin(EMPTY_CATEGORY_TOKENS))
            .distinct())


def valid_category(requests: DataFrame, catalogue: DataFrame, col: str,
                   req_col: str = "request", sep: str = r",\s*") -> DataFrame:
    """Each distinct request with ``valid`` = it is a known token."""
    toks = category_tokens(catalogue, col, sep).withColumn("_hit", F.lit(True))
    req = requests.select(req_col).distinct()
    return (req.join(toks, F.lower(F.trim(F.col(req_col))) == F.col("token"), "left")
            .select(req_col, F.coalesce(F.col("_hit"), F.lit(False)).alias("valid")))
