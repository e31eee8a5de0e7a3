"""Growth and seasonality. Every window here runs on one row per month, quarter or hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.operators.delivery import share_by


def qoq_growth(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Cost and revenue per quarter with growth on the quarter before.

    Summed per (product, quarter) before prices are joined: a best seller is one row per
    quarter by then.
    """
    per_product = (
        orders.select("order_id", "order_year", F.quarter("order_date").alias("order_quarter"), "order_total")
        .join(items.select("order_id", "product_id"), "order_id")
        .groupBy("product_id", "order_year", "order_quarter")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("order_total").alias("value"))
    )
    quarters = (
        per_product.join(products.select("product_id", "price"), "product_id")
        .groupBy("order_year", "order_quarter")
        .agg(
            N.total(F.col("price") * F.col("n")).alias("total_cost_price"),
            N.total("value").alias("total_order_value"),
        )
    )
    time = Window.orderBy("order_year", "order_quarter")
    return quarters.withColumns({
        "prev_cost_price": F.lag("total_cost_price").over(time),
        "prev_total_order_value": F.lag("total_order_value").over(time),
    }).select(
        "order_year", "order_quarter", "total_cost_price", "prev_cost_price",
        N.growth("total_cost_price", "prev_cost_price").alias("qoq_cost_price_growth"),
        "total_order_value", "prev_total_order_value",
        N.growth("total_order_value", "prev_total_order_value").alias("qoq_order_value_growth"),
    )


def mom_growth_calendar_month(orders: DataFrame) -> DataFrame:
    """January to December with all years merged, each against the month before."""
    months = orders.groupBy(
        F.month("order_date").alias("order_month_idx"), cal.month_title("order_date").alias("order_month")
    ).agg(F.count(F.lit(1)).alias("order_cnt"), N.total("order_total").alias("tov"))
    time = Window.orderBy("order_month_idx", "order_month")
    return months.withColumns({
        "prev_month_order_cnt": F.lag("order_cnt").over(time),
        "prev_month_tov": F.lag("tov").over(time),
    }).withColumns({
        "mom_order_size_growth_pct": N.growth("order_cnt", "prev_month_order_cnt"),
        "mom_revenue_growth_pct": N.growth("tov", "prev_month_tov"),
    })


def mom_revenue(orders: DataFrame) -> DataFrame:
    """Month on month; the first month shows 0 for the previous one and for growth."""
    months = orders.groupBy(cal.month_start("order_date").alias("order_month")).agg(
        F.count(F.lit(1)).alias("order_count"), N.total("order_total").alias("total_order_value")
    )
    time = Window.orderBy("order_month")
    lagged = months.withColumns({
        "prev_order_count": F.coalesce(F.lag("order_count").over(time), F.lit(0)),
        "prev_month_total_order_value": F.coalesce(F.lag("total_order_value").over(time), F.lit(0).cast("decimal(38,2)")),
    })
    return lagged.withColumns({
        "mom_order_growth": F.coalesce(N.growth("order_count", "prev_order_count"), F.lit(0.0)),
        "mom_growth": F.coalesce(N.growth("total_order_value", "prev_month_total_order_value"), F.lit(0.0)),
    })


def mau_growth(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    """Reviewed orders per month: count, average value and the growth of both."""
    months = (
        orders.select("order_id", "order_date", "order_total")
        .join(feedback.select("order_id"), "order_id")
        .groupBy(cal.month_start("order_date").alias("order_month"))
        .agg(F.count("order_id").alias("order_cnt"), N.mean_rounded("order_total").alias("aov"))
    )
    time = Window.orderBy("order_month")
    return months.withColumns({
        "prev_order_cnt": F.lag("order_cnt").over(time), "prev_aov_cnt": F.lag("aov").over(time),
    }).withColumns({
        "mom_order_cnt_growth": N.growth("order_cnt", "prev_order_cnt"),
        "mom_avg_aov_growth": N.growth("aov", "prev_aov_cnt"),
    })


def quarterly_performance(orders: DataFrame, feedback: DataFrame, dedupe: bool = False) -> DataFrame:
    """Volume, value, rating and delivery per month against the month before.

    By default an order is paired with every feedback of its customer. Orders are summed
    per (customer, month) and feedback per customer, and the sums weighted by the other
    side's counts, so the pairs never exist as rows. ``dedupe=True`` pairs an order only
    with its own feedback.
    """
    gaps = {
        "avg_delivery_delay": cal.minutes_between("order_date", "actual_delivery_time"),
        "avg_promised_delivery_delay": cal.minutes_between("actual_delivery_time", "promised_delivery_time"),
    }
    timed = orders.withColumns(gaps).select(
        "order_id", "customer_id", "order_total", *gaps, cal.month_start("order_date").alias("order_month")
    )
    measures = {"aov": "order_total", **{g: g for g in gaps}}
    key = "order_id" if dedupe else "customer_id"
    bought = timed.groupBy(key, "order_month").agg(
        F.count("order_id").alias("n"),
        *[F.sum(c).alias(f"{name}_sum") for name, c in measures.items()],
        *[F.count(c).alias(f"{name}_n") for name, c in measures.items()],
    )
    reviewed = feedback.groupBy(key).agg(
        F.count(F.lit(1)).alias("f"), F.sum("rating").alias("stars"), F.count("rating").alias("rated")
    )
    months = bought.join(reviewed, key).groupBy("order_month").agg(
        F.sum(F.col("n") * F.col("f")).alias("order_cnt"),
        N.half_up(N.ratio(F.sum(F.col("n") * F.col("stars")), F.sum(F.col("n") * F.col("rated")))).alias("avg_rating"),
        *[
            N.half_up(N.ratio(
                F.sum(F.col(f"{name}_sum") * F.col("f")), F.sum(F.col(f"{name}_n") * F.col("f"))
            )).alias(name)
            for name in measures
        ],
    )
    time = Window.orderBy("order_month")
    return months.select(
        "order_month", F.quarter("order_month").alias("quarter"), "order_cnt", "aov", "avg_rating",
        "avg_delivery_delay", "avg_promised_delivery_delay",
        F.lag("order_cnt").over(time).alias("prev_ord_cnt"),
        F.lag("aov").over(time).alias("prev_aov"),
        F.lag("avg_delivery_delay").over(time).alias("prev_avg_delivery_delay"),
        F.lag("avg_promised_delivery_delay").over(time).alias("prev_avg_promised_delivery_delay"),
    )


def hourly_orders_rank(orders: DataFrame) -> DataFrame:
    hours = orders.groupBy("order_hour").agg(
        F.count(F.lit(1)).alias("order_cnt"), N.mean_rounded("order_total").alias("aov")
    ).withColumn("timing_division_per_day", L.band("order_hour", L.DAY_PART_BANDS, L.DAY_PART_OTHER))
    best = Window.partitionBy("timing_division_per_day").orderBy(F.col("aov").desc_nulls_last())
    return hours.withColumn("aov_rank", F.dense_rank().over(best))


def month_week_sales(orders: DataFrame) -> DataFrame:
    week = F.concat(F.lit("Week "), F.ceil(F.day("order_date") / F.lit(7.0)).cast("int").cast("string"))
    weeks = orders.groupBy(cal.month_title("order_date").alias("order_month"), week.alias("week")).agg(
        F.count(F.lit(1)).alias("order_cnt"), N.mean_rounded("order_total").alias("aov")
    )
    best = Window.partitionBy("order_month").orderBy(F.col("aov").desc_nulls_last())
    return weeks.withColumn("aov_rank", F.dense_rank().over(best))


def price_vs_revenue_monthly(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order value against the list price of what was in the order, per month."""
    listed = F.round(F.col("unit_price") * F.col("quantity"), 2)
    lines = orders.select("order_id", "order_date", "order_total").join(
        items.select("order_id", listed.alias("listed")), "order_id"
    )
    return lines.groupBy(F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month")).agg(
        N.total("order_total").alias("total_order_value"),
        N.total("listed").alias("total_original_price"),
        N.half_up(F.sum("order_total") - F.sum("listed")).alias("total_revenue"),
        N.half_up(N.ratio(F.sum("listed"), F.sum("order_total")), 6).alias("total_revenue_ratio"),
    )


def monthly_avg_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_month").agg(N.mean_rounded("order_total", 6).alias("avg_sales_value"))


def yearly_revenue(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_year").agg(N.total("order_total").alias("order_total"))


def registrations_by_year(customers: DataFrame) -> DataFrame:
    return share_by(customers, "registration_year", "customer_id", "total_count", "regt_share")
