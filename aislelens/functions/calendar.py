"""Date parts that do not depend on the session time zone.

Timestamps here carry no zone, so everything goes through DATE or interval arithmetic;
functions that would convert to a zoned timestamp first are avoided.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def month_start(ts: Column | str) -> Column:
    return F.trunc(day_of(ts), "month")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Whole months from one month start to another, as INT."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def month_title(ts: Column | str) -> Column:
    """Lower-case English month name, blank-padded to nine characters."""
    return F.rpad(F.lower(F.date_format(day_of(ts), "MMMM")), 9, " ")


def iso_week_period(ts: Column | str) -> Column:
    """ISO week as 'Monday/Sunday'."""
    monday = F.trunc(day_of(ts), "week")
    return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minutes from start to end as DOUBLE; negative when end is earlier."""
    seconds = (_col(end) - _col(start)).cast("interval second").cast("decimal(18,6)")
    return seconds.cast("double") / 60


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Completed 24-hour days from start to end."""
    return F.date_part(F.lit("DAY"), _col(end) - _col(start))


def calendar_days(start: Column | str, end: Column | str) -> Column:
    """Difference of the two calendar dates."""
    return F.date_diff(day_of(end), day_of(start))
