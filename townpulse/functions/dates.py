"""Date keys and conversions. All of them are plain Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats of the flat table and of the freshness line.
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
FRESHNESS_FORMAT = "dd.MM.yyyy HH:mm"


def from_epoch(seconds) -> Column:
    """Epoch seconds to a timestamp."""
    return F.timestamp_seconds(F.col(seconds) if isinstance(seconds, str) else seconds)


def stamp_text(ts) -> Column:
    """Timestamp as ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(ts, STAMP_FORMAT)


def year_of(ts) -> Column:
    return F.year(ts)


def week_start(ts) -> Column:
    """The Monday of the week, as a date."""
    return F.trunc(F.to_date(ts), "week")


def week_label(ts) -> Column:
    """The week as ``Monday/Sunday``, both ``yyyy-MM-dd``."""
    monday = week_start(ts)
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def month_of_week(ts) -> Column:
    """First day of the month that holds the week's Monday.

    New Year's Day 2025 is a Wednesday, so it counts in December 2024.
    """
    return F.trunc(week_start(ts), "month")


def calendar_month(ts) -> Column:
    """First day of the month the instant itself lies in."""
    return F.trunc(F.to_date(ts), "month")


def parse_lenient(text, fmt: str | None = None) -> Column:
    """Parse a timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def parse_strict(text, fmt: str | None = None) -> Column:
    """Parse a timestamp; unreadable text fails the job (under ANSI mode)."""
    return F.to_timestamp(text, fmt) if fmt else F.to_timestamp(text)


def next_months(last, count: int) -> Column:
    """Array of the ``count`` month starts after ``last``."""
    return F.sequence(
        F.add_months(last, 1), F.add_months(last, count), F.expr("interval 1 month")
    )


def days_ago(days: int) -> Column:
    """The instant ``days`` days before now."""
    return F.current_timestamp() - F.make_dt_interval(F.lit(days))


def in_range(ts, start, end, end_inclusive: bool = True) -> Column:
    """``start <= ts <= end``; either bound may be None.

    A bare date (``datetime.date`` or ``yyyy-MM-dd``) as the end means that
    whole day, or with ``end_inclusive=False`` nothing of that day. Instants
    are compared as they are; ``end_inclusive=False`` leaves the instant out.
    """
    column = F.col(ts) if isinstance(ts, str) else ts
    checks = []
    if start is not None:
        checks.append(column >= instant(start))
    if end is not None:
        if _is_bare_date(end):
            edge = F.lit(end).cast("date")
            edge = F.date_add(edge, 1) if end_inclusive else edge
            checks.append(column < edge.cast("timestamp_ntz"))
        else:
            edge = instant(end)
            checks.append(column <= edge if end_inclusive else column < edge)
    result = F.lit(True)
    for check in checks:
        result = result & check
    return result


def instant(value) -> Column:
    """A bound as a literal; date-times with a zone are turned to UTC."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def _is_bare_date(value) -> bool:
    if isinstance(value, dt.datetime):
        return False
    if isinstance(value, dt.date):
        return True
    return isinstance(value, str) and len(value.strip()) == 10
