"""Pages deep inside an ordered table, and the newest rows of a history.

``ORDER BY ... LIMIT n OFFSET m`` passes the first n + m rows through one
task. A deep page instead looks for the rows at its two ends by order
statistics: a few rows of the present range, drawn at random and sorted,
cut it into pieces; one aggregate counts the rows of the pieces; the piece
that holds the wanted place is the next range. Each round reads the table
once and shrinks the range by about ``PIECES``. When the rows between both
ends fit ``MOST_ROWS``, only they are sorted.

The newest rows of a stored history are in its last days: whole days are
counted, newest first and twice as many each time, until they hold enough
rows, and only those days are sorted.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.predicates import check_page

#: Pieces a range is cut into, and rows drawn to find the cuts.
PIECES, DRAWN = 16, 2048
#: Rows that are sorted in the end, when the order tells rows apart.
MOST_ROWS = 20_000


@dataclass(frozen=True)
class By:
    """A column of the order. Nulls come first, or last when descending, as
    Spark and SQL engines with that default have them."""
    column: str
    descending: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def before(self, value) -> Column:
        """Rows that come before ``value`` in this column."""
        c = F.col(self.column)
        if value is None:
            return c.isNotNull() if self.descending else F.lit(False)
        if self.descending:
            return F.coalesce(c > F.lit(value), F.lit(False))
        return F.coalesce(c < F.lit(value), F.lit(True))

    def same(self, value) -> Column:
        return F.col(self.column).eqNullSafe(F.lit(value)) if value is not None else F.col(self.column).isNull()


Place = tuple


def before(by: list[By], place: Place) -> Column:
    """Rows that come before a place (a value for every column)."""
    out, equal = F.lit(False), F.lit(True)
    for b, value in zip(by, place):
        out = out | (equal & b.before(value))
        equal = equal & b.same(value)
    return out


def _within(df: DataFrame, by: list[By], low: Place | None, high: Place | None) -> DataFrame:
    """Rows from ``low`` (included) up to ``high`` (excluded). The bounds of
    the first column stand alone, so that they reach the scan."""
    if low is not None:
        first = by[0].before(low[0])
        df = df.filter(~first).filter(~before(by, low))
    if high is not None:
        df = df.filter(by[0].before(high[0]) | by[0].same(high[0])).filter(before(by, high))
    return df


def _drawn(df: DataFrame, by: list[By], rows: int) -> list[Place]:
    """Some places of the range, in order: about ``DRAWN`` of its rows."""
    share = min(1.0, 2.0 * DRAWN / max(rows, 1))
    part = df.select(*(b.column for b in by))
    part = part.sample(share, seed=rows % 9973) if share < 1 else part
    found = part.limit(4 * DRAWN).distinct().orderBy(*(b.order() for b in by)).collect()
    return [tuple(r) for r in found]


def _narrow(df: DataFrame, by: list[By], place: int, low: Place | None, high: Place | None, skipped: int,
            rows: int) -> tuple[Place | None, Place | None, int, int] | None:
    """The piece of a range that holds the row at ``place`` (from 0, in the
    whole order): its ends, the rows before it, and its rows. None when the
    range cannot be cut any more."""
    drawn = _drawn(_within(df, by, low, high), by, rows)
    step = max(1, len(drawn) // PIECES)
    cuts = [p for p in drawn[step::step] if p != low][:2 * PIECES]
    if not cuts:
        return None
    counted = _within(df, by, low, high).agg(*(F.count_if(before(by, p)).alias(f"c{i}") for i, p in enumerate(cuts))).first()
    ends = [skipped, *(skipped + int(c) for c in counted), skipped + rows]
    places = [low, *cuts, high]
    for i in range(len(places) - 1):
        if ends[i] <= place < ends[i + 1]:
            return places[i], places[i + 1], ends[i], ends[i + 1] - ends[i]
    return None


def deep_page(df: DataFrame, by: list[By], limit: int = 10, offset: int = 0, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in the order ``by``.

    The order should tell rows apart (end with an id): rows that are equal
    in all its columns stay together, however many they are, and any of them
    may be returned."""
    check_page(limit, offset)
    rows = df.count()
    if offset >= rows:
        return df.limit(0)
    last = min(offset + limit, rows) - 1
    ends = []
    for place in (offset, last):
        # mostly both ends lie in one piece
        at = ends[0] if ends and place < ends[0][2] + ends[0][3] else (None, None, 0, rows)
        while at[3] > most_rows // 2:
            cut = _narrow(df, by, place, *at)
            if cut is None or cut[3] == at[3]:
                break
            at = cut
        ends.append(at)
    (low, _, skipped, _), (_, high, _, _) = ends
    wanted = _within(df, by, low, high).orderBy(*(b.order() for b in by))
    return wanted.offset(offset - skipped).limit(limit) if offset > skipped else wanted.limit(limit)


def stored_days(history: DataFrame) -> list[dt.date]:
    """The days a stored history has, newest first, from the names of its
    folders: no file is opened."""
    found = {f.rpartition("/day=")[2].split("/")[0] for f in history.inputFiles() if "/day=" in f}
    return sorted((dt.date.fromisoformat(d) for d in found if d[:1].isdigit()), reverse=True)


def newest(history: DataFrame, ts_col: str, n: int, tiebreak: list[str] | None = None,
           keep: Column | None = None) -> DataFrame:
    """The newest ``n`` rows of a history partitioned by ``day``, the day of
    ``ts_col``; with ``keep`` the newest ``n`` of the rows that it keeps.

    Rows of a later day are newer whatever their time, so ties never cross
    days. Rows without a time come last; they are read only when the days
    hold fewer than ``n`` rows."""
    order = [F.col(ts_col).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in tiebreak or [])]
    rows = history if keep is None else history.filter(keep)
    days, taken, width, found = stored_days(history), 0, 1, 0
    while taken < len(days) and found < n:
        part = days[taken:taken + width]
        # without a condition on rows the count comes from the files' footers
        found += rows.filter(F.col("day").between(part[-1], part[0])).count()
        taken, width = taken + len(part), 2 * width
    if found >= n:
        rows = rows.filter(F.col("day") >= F.lit(days[taken - 1]))
    return rows.orderBy(*order).limit(n)
