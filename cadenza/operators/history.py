"""History questions by kind, date range and source; ordered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import predicates as P
from cadenza.operators.summary import score_summary
from cadenza.schema import KIND_COLUMNS


def history(df: DataFrame, ts_col: str, start=None, end=None, mode: str = "next_midnight",
            source: str | None = None, source_col: str = "source",
            columns: list[str] | None = None, kind: str | None = None,
            latest_n: int | None = None, filter_after_limit: bool = False,
            tiebreak: list[str] | None = None) -> DataFrame:
    """Rows of one history table inside a date range and source.

    ``kind`` picks the stored projection of a prediction kind (unknown kind
    is an error). With ``latest_n`` only the newest N rows are returned;
    by default filters run first so they reach the scan, and
    ``filter_after_limit=True`` keeps the older order (limit, then filter).
    """
    if kind is not None:
        if kind not in KIND_COLUMNS:
            raise ValueError(f"unknown prediction type {kind!r}")
        columns = columns or KIND_COLUMNS[kind]
    cond = P.between_days(ts_col, start, end, mode)
    newest = [F.col(ts_col).desc()] + [F.col(c).desc() for c in (tiebreak or [])]

    def filt(d):
        d = d.filter(cond)
        if "day" in d.columns:  # the partition column: whole days are not read
            d = d.filter(P.day_bounds("day", start, end, mode))
        return P.source_is(d, source_col, source)

    if latest_n is not None and filter_after_limit:
        out = filt(df.orderBy(*newest).limit(latest_n))
    elif latest_n is not None:
        out = filt(df).orderBy(*newest).limit(latest_n)
    else:
        out = filt(df)
    return out.select(*columns) if columns else out


def history_by_day(df: DataFrame, ts_col: str, score_col: str, start=None, end=None) -> DataFrame:
    """Count and mean score per calendar day inside an inclusive date range."""
    d = df.filter(P.between_days(ts_col, start, end, "date"))
    return score_summary(d.withColumn("day", F.to_date(ts_col)), score_col, ["day"])
