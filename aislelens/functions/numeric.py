"""Rounding, means, shares and growth rates.

Money is summed as DECIMAL (exact whatever the order of the partial sums); totals stay
DECIMAL, and only means, shares and rates are DOUBLE. Every division is NULL on a zero denominator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half a unit in the last place of a money value is far above this, so adding it only
# decides ties (2.675 stored as 2.67499..), the same way in any engine.
TIE = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(value: Column | str, digits: int = 2) -> Column:
    """Round half away from zero, as a DOUBLE."""
    v = _col(value).cast("double")
    return F.round(v + F.signum(v) * F.lit(TIE), digits)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def percent(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return half_up(F.try_divide(_col(part).cast("double") * 100.0, _col(whole).cast("double")), digits)


def whole_percent(part: Column | str, whole: Column | str) -> Column:
    """Percentage by integer division: the fraction is cut off, not rounded."""
    return F.call_function("div", _col(part) * 100, F.nullif(_col(whole), F.lit(0))).cast("double")


def growth(now: Column | str, before: Column | str, digits: int = 2) -> Column:
    now, before = _col(now).cast("double"), _col(before).cast("double")
    return half_up(F.try_divide((now - before) * 100.0, before), digits)


def total(value: Column | str) -> Column:
    """Exact sum: money keeps its cents at any size."""
    return F.sum(_col(value)).cast("decimal(38,2)")


def mean(value: Column | str) -> Column:
    """Unrounded mean of the non-null values."""
    v = _col(value)
    return ratio(F.sum(v), F.count(v))


def mean_rounded(value: Column | str, digits: int = 2) -> Column:
    return half_up(mean(value), digits)


def tally(condition: Column) -> Column:
    """How many rows satisfy the condition (NULL counts as no)."""
    return F.count_if(condition)
