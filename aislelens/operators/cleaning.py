"""Parsing, enrichment and schema changes. Every job here is one narrow stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Turn text columns into zone-free timestamps, each by its own format."""
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c), F.lit(f)) for c, f in formats.items()})


def order_enrich(orders: DataFrame) -> DataFrame:
    """Minutes to deliver, and minutes ahead of the promise (positive = early)."""
    return orders.withColumns({
        "delivery_gap_in_minutes": cal.minutes_between("order_date", "actual_delivery_time"),
        "gap_between_promised_actual_time": cal.minutes_between("actual_delivery_time", "promised_delivery_time"),
    })


def delivery_gap_flag(
    orders: DataFrame, bands: list[L.Band] = L.DELIVERY_GAP_BANDS, other: str = L.DELIVERY_GAP_OTHER
) -> DataFrame:
    return orders.withColumn("delivery_gap_flag", L.band("delivery_gap_in_minutes", bands, other))


def calendar_parts(df: DataFrame, ts: str, prefix: str, names: dict[str, str] | None = None) -> DataFrame:
    """Add year, month, week, weekday, week period, day and hour of a timestamp.

    Columns are called ``<prefix>_<part>``; ``names`` restricts and renames the parts.
    """
    t = F.col(ts)
    parts = {
        "year": F.year(t),
        "month": F.month(t),
        "week": F.weekofyear(t),
        "day_name": F.dayname(t),
        "weekly_period": cal.iso_week_period(t),
        "day": F.day(t),
        "hour": F.hour(t),
    }
    names = names or {p: p for p in parts}
    return df.withColumns({f"{prefix}_{new}": parts[part] for part, new in names.items()})


# Which calendar parts each table carries, and under which name.
ORDER_PARTS = {
    "year": "year", "month": "month", "week": "week", "day_name": "day",
    "weekly_period": "weekly_period", "hour": "hour",
}
FEEDBACK_PARTS = {
    "year": "year", "month": "month", "day_name": "day_name", "week": "week",
    "weekly_period": "period", "day": "day",
}
CUSTOMER_PARTS = {"year": "year", "month": "month"}
DELIVERY_PARTS = {
    "year": "year", "month": "month", "day": "day", "week": "week", "weekly_period": "week_period",
}


def normalise_text(df: DataFrame, lower: list[str], replace: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Lower-case some columns and map listed spellings of others."""
    out = df.withColumns({c: F.lower(c) for c in lower})
    for column, spellings in (replace or {}).items():
        out = out.replace(spellings, subset=[column])
    return out


def fill_missing_reason(delivery: DataFrame, fill: str = L.REASON_MISSING) -> DataFrame:
    return delivery.na.fill({"reasons_if_delayed": fill})


def distance_flag_closed_bands(delivery: DataFrame) -> DataFrame:
    return delivery.withColumn(
        "delivery_distance_flag", L.band("distance_km", L.DISTANCE_FLAG_BANDS, L.DISTANCE_FLAG_OTHER)
    )


def distance_category_cumulative(delivery: DataFrame) -> DataFrame:
    return delivery.withColumn(
        "delivery_distance_category",
        L.band("distance_km", L.DISTANCE_CATEGORY_BANDS, L.DISTANCE_CATEGORY_OTHER),
    )


def product_profit(products: DataFrame) -> DataFrame:
    return products.withColumn("profit", F.round(F.col("mrp") - F.col("price"), 2))


def schema_evolution(
    df: DataFrame,
    casts: dict[str, str] | None = None,
    renames: dict[str, str] | None = None,
    drops: list[str] | None = None,
) -> DataFrame:
    """Change types, then names, then drop; dropping an absent column is no error."""
    out = df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()})
    return out.withColumnsRenamed(renames or {}).drop(*(drops or []))


def clean_orders(orders: DataFrame) -> DataFrame:
    out = delivery_gap_flag(order_enrich(normalise_text(orders, ["payment_method"])))
    return calendar_parts(out, "order_date", "order", ORDER_PARTS).drop("store_id")


def clean_feedback(feedback: DataFrame) -> DataFrame:
    out = normalise_text(feedback, ["feedback_category", "sentiment"])
    return calendar_parts(out, "feedback_date", "feedback", FEEDBACK_PARTS)


def clean_customers(customers: DataFrame) -> DataFrame:
    return calendar_parts(customers, "registration_date", "registration", CUSTOMER_PARTS)


def clean_products(products: DataFrame) -> DataFrame:
    return product_profit(normalise_text(products, ["product_name", "category"]))


def clean_delivery(delivery: DataFrame) -> DataFrame:
    out = normalise_text(delivery, ["delivery_status"], {"reasons_if_delayed": L.REASON_SPELLINGS})
    out = calendar_parts(fill_missing_reason(out), "promised_time", "delivery", DELIVERY_PARTS)
    return distance_category_cumulative(distance_flag_closed_bands(out))
