"""Row predicates. Options that switch a filter off are decided when the
plan is built (no per-row test of a constant)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.schema import ALL_WORDS, PAGE_LIMIT_RANGE, SOURCE_ALL


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def in_range(col, lo, hi) -> Column:
    """Closed range; missing and NaN fail (pandas comparison semantics)."""
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & c.between(lo, hi)


def contains_ci(col, text: str, regex: bool = False) -> Column:
    """Case-insensitive contains; missing is no match. ``regex=True``
    treats ``text`` as a regular expression (lower-cased, like the
    original); by default it is literal."""
    c = F.lower(_c(col))
    hit = c.rlike(text.lower()) if regex else c.contains(text.lower())
    return F.coalesce(hit, F.lit(False))


def category(df: DataFrame, col: str, value: str | None, regex: bool = False) -> DataFrame:
    """Category filter with an "all" bypass in any case."""
    if value is None or value.lower() in ALL_WORDS:
        return df
    return df.filter(contains_ci(col, value, regex))


def source_is(df: DataFrame, col: str, value: str | None) -> DataFrame:
    """Equality filter with an ALL/all bypass."""
    if value is None or value in SOURCE_ALL:
        return df
    return df.filter(F.col(col) == value)


def _day(d) -> dt.datetime:
    if isinstance(d, str):
        return dt.datetime.strptime(d, "%Y-%m-%d")
    if isinstance(d, dt.datetime):
        return d
    return dt.datetime(d.year, d.month, d.day)


def between_days(col, start=None, end=None, mode: str = "next_midnight") -> Column:
    """Date-range predicate on a timestamp, each bound optional.

    ``next_midnight``: start <= ts <= end + 1 day (next midnight included);
    ``midnight``: start <= ts <= end at 00:00 (the end day itself is lost);
    ``date``: calendar dates, both ends inclusive.
    """
    c = _c(col)
    cond = F.lit(True)
    if mode == "date":
        if start is not None:
            cond = cond & (F.to_date(c) >= F.lit(_day(start).date()))
        if end is not None:
            cond = cond & (F.to_date(c) <= F.lit(_day(end).date()))
        return cond
    if start is not None:
        cond = cond & (c >= F.lit(_day(start)))
    if end is not None:
        e = _day(end) + (dt.timedelta(days=1) if mode == "next_midnight" else dt.timedelta(0))
        cond = cond & (c <= F.lit(e))
    return cond


def day_bounds(col, start=None, end=None, mode: str = "next_midnight") -> Column:
    """The days that :func:`between_days` can reach: a filter for a day
    partition column."""
    last = None if end is None else _day(end) + dt.timedelta(days=1 if mode == "next_midnight" else 0)
    return between_days(col, start, last, "date")


def above_max(col, limit) -> Column:
    """True for rows above ``limit`` (shown), false at or below (kept)."""
    return _c(col) > limit


def split_max(df: DataFrame, col: str, limit) -> tuple[DataFrame, DataFrame]:
    """(rows above ``limit``, rows at or below it)."""
    above = above_max(col, limit)
    return df.filter(above), df.filter(~above)


def check_page(limit: int, offset: int) -> None:
    lo, hi = PAGE_LIMIT_RANGE
    if not (lo <= limit <= hi):
        raise ValueError(f"limit must be in {lo}..{hi}")
    if offset < 0:
        raise ValueError("offset must be >= 0")


def page(df: DataFrame, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """Ordered page: ORDER BY ... LIMIT/OFFSET. Spark plans this as a
    per-partition top-(offset+limit) followed by one small merge, never a
    full sort of the input."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)
