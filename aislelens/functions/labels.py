"""The labels, band edges and score thresholds results must carry.

Bands are listed in the order they are tried; the first match wins. An edge of None is
open. ``closed`` tells which ends belong to the band: "both", "left", "right" or "neither".
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Band(NamedTuple):
    low: float | None
    high: float | None
    label: str | int
    closed: str = "both"


# ---- fixed values -------------------------------------------------------------------

# Minutes from order to delivery. Exactly 40 falls between the last two bands.
DELIVERY_GAP_BANDS = [
    Band(None, 10, "on time", "neither"),
    Band(10, 20, "slightly late", "left"),
    Band(20, 40, "very late", "left"),
    Band(40, None, "concerningly late", "neither"),
]
DELIVERY_GAP_OTHER = "unknown timing"

# Promised minus actual delivery, in whole minutes; values between bands are "other".
DELIVERY_TIMING_BANDS = [
    Band(-5, -1, "slightly late delivery"),
    Band(-10, -6, "moderate late delivery"),
    Band(-15, -11, "late delivery"),
    Band(-20, -16, "very late delivery"),
    Band(-25, -21, "concerningly late delivery"),
    Band(-30, -26, "customer might churn if delivery becomes this late"),
    Band(0, 5, "slightly fast delivery"),
    Band(6, 10, "moderate late delivery"),
    Band(11, 15, "late delivery"),
    Band(16, 20, "very late delivery"),
    Band(21, 25, "concerningly late delivery"),
]
DELIVERY_TIMING_OTHER = "other timing"

DISTANCE_FLAG_BANDS = [
    Band(0, 0.99, "below 1 km"),
    Band(1, 1.99, "between 1 km"),
    Band(2, 2.99, "between 2 km"),
    Band(3, 3.99, "between 3 km"),
    Band(4, 5, "between 4 km"),
]
DISTANCE_FLAG_OTHER = "unknown distance"

DISTANCE_CATEGORY_BANDS = [
    Band(None, 1, "below 1 km"),
    Band(None, 2, "below 2 km"),
    Band(None, 3, "below 3 km"),
    Band(None, 4, "below 4 km"),
    Band(None, 5, "below 5 km"),
]
DISTANCE_CATEGORY_OTHER = "above 5 km"

# Customer scores, 1 best. Monetary bands leave holes for fractions (3000.50 scores 5).
RECENCY_BANDS = [Band(0, 20, 1), Band(21, 35, 2), Band(36, 50, 3), Band(51, 80, 4)]
FREQUENCY_BANDS = [Band(7, 9, 1), Band(4, 6, 2), Band(3, 3, 3), Band(2, 2, 4)]
MONETARY_BANDS = [
    Band(5000, None, 1, "neither"),
    Band(3001, 5000, 2),
    Band(1501, 3000, 3),
    Band(801, 1500, 4),
]
SCORE_OTHER = 5

# Recency for the quintile segments, 5 best.
RECENCY_QUINTILE_BANDS = [Band(None, 7, 5), Band(None, 30, 4), Band(None, 90, 3), Band(None, 180, 2)]
RECENCY_QUINTILE_OTHER = 1

# (least recency score, least frequency tile, least monetary tile, segment)
RFM_SEGMENTS = [
    (4, 1, 1, "Champions"),
    (4, 2, 2, "Loyal customer"),
    (3, 3, 3, "Potential loyalist"),
    (2, 1, 2, "At risk"),
    (1, 1, 1, "Churned"),
]
RFM_SEGMENT_OTHER = "Others"

LATE_RATE_BANDS = [
    Band(None, 25, "25% late deliveries", "neither"),
    Band(25, 50, "50% late deliveries"),
    Band(50, 75, "75% late deliveries"),
]
LATE_RATE_OTHER = "all late deliveries"

DAY_PART_BANDS = [
    Band(0, 6, "night to early morning"),
    Band(7, 12, "morning to day"),
    Band(13, 18, "noon to evening"),
    Band(19, 24, "night time"),
]
DAY_PART_OTHER = "other timing"

ORDER_VALUE_BANDS = [
    Band(None, 0.49, "(< 0.49) heavily discounted outliers (heavily discounted conditions, more than 70% of discount!)"),
    Band(0.5, 1.25, "(0.5 --> 1.25) safety net"),
]
ORDER_VALUE_OTHER = "(>2) heavily charged"

LATE, ON_TIME = "late delivery", "on time delivery"
VALUE_DOWN, VALUE_UP, VALUE_SAME = "degraded order value", "increased order value", "others"
RETENTION_UP = "retention improved"

# (sign of the change in order value, sign of the change in delivery gap) -> label
VALUE_AND_TIMING = {
    (-1, 1): "degraded order value but delivery timing improved",
    (-1, -1): "degraded order value, delivery timing is still bad",
    (1, 1): "increased order value even after a delivery gap",
    (1, -1): "increased order value improved delivery timing",
    (-1, 0): "decreased order value but delivery timing stayed same",
    (1, 0): "increased order value but delivery timing stayed same",
}
VALUE_AND_TIMING_OTHER = "unknown timing and order value"

POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"
DELIVERY, PRODUCT_QUALITY = "delivery", "product quality"
TRAFFIC, REASON_MISSING = "traffic", "not given"
REASON_SPELLINGS = {"Traffic": "traffic"}

# ---- end of fixed values ------------------------------------------------------------


def band(value: Column | str, bands: list[Band], other: str | int) -> Column:
    """Label of the first band holding the value; ``other`` for gaps and NULL."""
    v = F.col(value) if isinstance(value, str) else value
    label = None
    for b in bands:
        test = F.lit(True)
        if b.low is not None:
            test = v >= b.low if b.closed in ("both", "left") else v > b.low
        if b.high is not None:
            upper = v <= b.high if b.closed in ("both", "right") else v < b.high
            test = upper if b.low is None else test & upper
        label = F.when(test, F.lit(b.label)) if label is None else label.when(test, F.lit(b.label))
    return label.otherwise(F.lit(other))
