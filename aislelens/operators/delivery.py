"""Delivery punctuality: its feedback, its effect on the next order, distance and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.functions.timeline import carried, slice_hot_keys, with_next

ORDER = ["order_date", "order_id"]
AHEAD = "gap_between_promised_actual_time"


def _overall(column: str) -> Column:
    """Sum over all rows; used only on results already grouped by a few labels."""
    return F.sum(column).over(Window.partitionBy())


def _timeline(orders: DataFrame, columns: list[str], take: dict[str, str]) -> DataFrame:
    """Orders (only the columns needed) with values of the customer's next order."""
    needed = list(dict.fromkeys(["customer_id", *ORDER, *columns, *take.values()]))
    narrow = orders.select(*needed, *carried(orders))
    sliced = slice_hot_keys(narrow, ["customer_id"], "order_date")
    return with_next(sliced, ["customer_id"], ORDER, take)


def _pattern() -> Column:
    return F.when(F.col(AHEAD) < 0, L.LATE).otherwise(L.ON_TIME)


def _bad() -> Column:
    return F.col("sentiment") == L.NEGATIVE


def _bad_delivery() -> Column:
    return _bad() & (F.col("feedback_category") == L.DELIVERY)


def delivery_timing_feedback(
    feedback: DataFrame, orders: DataFrame,
    bands: list[L.Band] = L.DELIVERY_TIMING_BANDS, other: str = L.DELIVERY_TIMING_OTHER,
) -> DataFrame:
    """Feedback per band of delivery timing; feedback without an order is 'other'."""
    rated = feedback.select("order_id", "sentiment", "feedback_category").join(
        orders.select(F.col("order_id").alias("matched_id"), AHEAD),
        F.col("order_id") == F.col("matched_id"), "left",
    )
    grouped = rated.groupBy(L.band(AHEAD, bands, other).alias("delivery_timing_range")).agg(
        N.mean_rounded(AHEAD).alias("avg_gap_between_promised_and_actual_time"),
        F.count("matched_id").alias("order_cnt"),
        F.count(F.lit(1)).alias("_rows"),
        N.tally(_bad()).alias("negative_fdbk_cnt"),
        N.tally(_bad_delivery()).alias("neg_fdbk_for_delivery_cnt"),
    )
    bad = F.col("neg_fdbk_for_delivery_cnt")
    return grouped.withColumns({
        "neg_fdbk_for_delivery_among_all_neg_reviews_pct": N.percent(bad, "negative_fdbk_cnt"),
        "neg_review_for_delivery_among_all_orders_pct": N.percent(bad, _overall("_rows")),
        "order_contribution_pct": N.percent("order_cnt", _overall("order_cnt")),
    }).drop("_rows")


def hourly_delivery(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_hour").agg(
        F.count("customer_id").alias("customer_visit_count"),
        N.mean_rounded(AHEAD).alias("avg_promised_delivery_gap_timing"),
        N.tally(F.col(AHEAD) > 0).alias("on_time_delivery_count"),
        N.tally(F.col(AHEAD) < 0).alias("late_delivery_count"),
    )


def late_penalty(orders: DataFrame) -> DataFrame:
    """Days until the next order after a late and after a punctual delivery.

    Rows are first counted per day gap (bounded by the calendar), so the exact median
    reads a short weighted list instead of every order.
    """
    followed = _timeline(orders, [AHEAD], {"next_date": "order_date"}).filter("next_date is not null")
    per_gap = followed.groupBy(
        _pattern().alias("delivery_pattern"), cal.calendar_days("order_date", "next_date").alias("days")
    ).agg(F.count(F.lit(1)).alias("n"))
    return per_gap.groupBy("delivery_pattern").agg(
        F.sum("n").alias("sample_size"),
        N.half_up(N.ratio(F.sum(F.col("days") * F.col("n")), F.sum("n"))).alias("avg_delivery_delay"),
        F.percentile("days", 0.5, F.col("n")).alias("median_days_to_next_order"),
    )


def churn_after_delivery(orders: DataFrame) -> DataFrame:
    followed = _timeline(orders, [AHEAD], {"next_date": "order_date"})
    return followed.groupBy(_pattern().alias("delivery_pattern")).agg(
        F.count(F.lit(1)).alias("total_order_count"),
        N.percent(N.tally(F.col("next_date").isNull()), F.count(F.lit(1))).alias("churn_rate_pct"),
    )


def gap_flag_revenue(orders: DataFrame) -> DataFrame:
    """``avg_total_value`` is a sum: the column keeps the name its readers know."""
    return orders.filter("delivery_gap_in_minutes <> 0").groupBy("delivery_gap_flag").agg(
        F.count(F.lit(1)).alias("total_order_cnt"),
        N.total("order_total").alias("avg_total_value"),
        N.mean_rounded("delivery_gap_in_minutes").alias("avg_delivery_gap"),
    )


def late_rate_buckets(orders: DataFrame) -> DataFrame:
    """Customers with several orders, by the share of their orders that came late."""
    per_customer = orders.groupBy("customer_id").agg(
        N.percent(N.tally(F.col(AHEAD) < 0), F.count(F.lit(1))).alias("late_rate"),
        N.mean_rounded("order_total").alias("aov"),
        F.sum("order_total").alias("spent"),
        F.count(F.lit(1)).alias("n"),
    ).filter("n > 1")
    bucket = L.band("late_rate", L.LATE_RATE_BANDS, L.LATE_RATE_OTHER)
    return per_customer.groupBy(bucket.alias("delivery_pattern")).agg(
        F.count("customer_id").alias("customer_count"),
        N.half_up(F.avg("aov")).alias("avg_order_value"),
        N.total("spent").alias("total_order_value"),
    )


def revenue_leakage(orders: DataFrame) -> DataFrame:
    """Whether customers spend less, more or the same on the next order; repeated
    (customer, total, next total) combinations count once."""
    everyone = orders.agg(F.countDistinct("customer_id")).scalar()
    steps = (
        _timeline(orders, ["order_total"], {"next_total": "order_total"})
        .filter("next_total is not null")
        .select("customer_id", "order_total", "next_total")
        .distinct()
    )
    change = F.col("next_total") - F.col("order_total")
    label = F.when(change < 0, L.VALUE_DOWN).when(change > 0, L.VALUE_UP).otherwise(L.VALUE_SAME)
    return steps.groupBy(label.alias("penalty_order_analysis")).agg(
        F.count("customer_id").alias("cust_count"),
        N.percent(F.countDistinct("customer_id"), everyone).alias("customer_share_pct"),
    )


def delay_vs_next_value(orders: DataFrame) -> DataFrame:
    """Movement of order value against movement of delivery timing, order to order."""
    followed = _timeline(
        orders, ["order_total", AHEAD], {"next_total": "order_total", "next_ahead": AHEAD}
    ).filter("next_total is not null and next_ahead is not null")
    value = F.signum(F.col("next_total") - F.col("order_total"))
    timing = F.signum(F.col("next_ahead") - F.col(AHEAD))
    label = F.lit(L.VALUE_AND_TIMING_OTHER)
    for (v, t), text in L.VALUE_AND_TIMING.items():
        label = F.when((value == v) & (timing == t), text).otherwise(label)
    everything = orders.agg(F.count("order_id")).scalar()
    return followed.groupBy(label.alias("delivery_corr_order_volume")).agg(
        F.count(F.lit(1)).alias("order_count"),
        N.mean_rounded("order_total").alias("avg_total_order_value"),
        N.percent(F.count("customer_id"), everything).alias("order_count_pct"),
    )


def recovered_delivery_pct(orders: DataFrame) -> DataFrame:
    """Orders followed by a better-timed one, and by one delivered on time, of all orders."""
    followed = _timeline(orders, [AHEAD], {"next_ahead": AHEAD})
    better = F.col("next_ahead") > F.col(AHEAD)
    everything = F.count(F.lit(1))
    return followed.agg(
        N.percent(N.tally(better), everything).alias("next_order_good_delivery_pct"),
        N.percent(N.tally(better & (F.col("next_ahead") >= 0)), everything)
        .alias("nxt_delivery_ordered_before_promised_timing_pct"),
    )


def area_delivery(orders: DataFrame, customers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Area by feedback category.

    Rows are summed per (customer, category) before the customer join: that join then has
    at most one row per customer and category, and counting those rows per area is the
    distinct customer count.
    """
    def parts(name: str, column: str) -> list[Column]:
        return [F.sum(column).alias(f"{name}_sum"), F.count(column).alias(f"{name}_n")]

    measures = {
        "aov": "order_total",
        "avg_rating_per_category": "rating",
        "avg_delivery_delay": "delivery_gap_in_minutes",
        "avg_promised_delivery_delay": AHEAD,
    }
    per_customer = (
        orders.select("order_id", "customer_id", "order_total", "delivery_gap_in_minutes", AHEAD)
        .join(feedback.select("order_id", "rating", "feedback_category"), "order_id")
        .groupBy("customer_id", "feedback_category")
        .agg(F.count(F.lit(1)).alias("n"), *[p for name, c in measures.items() for p in parts(name, c)])
    )
    return (
        per_customer.join(customers.select("customer_id", "area"), "customer_id")
        .groupBy("area", "feedback_category")
        .agg(
            F.count(F.lit(1)).alias("customer_count_per_area"),
            F.sum("n").alias("order_cnt"),
            *[
                N.half_up(N.ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))).alias(name)
                for name in measures
            ],
        )
    )


def hourly_delivery_feedback(orders: DataFrame, customers: DataFrame, feedback: DataFrame) -> DataFrame:
    per_customer = (
        orders.select(
            "order_id", "customer_id", "order_hour", "order_total",
            "promised_delivery_time", "actual_delivery_time",
        )
        .join(feedback.select("order_id", "sentiment", "feedback_category"), "order_id")
        .groupBy("customer_id", "order_hour")
        .agg(
            F.count("order_id").alias("n"),
            F.sum("order_total").alias("spent"),
            F.count("order_total").alias("paid"),
            N.tally(F.col("promised_delivery_time") < F.col("actual_delivery_time")).alias("late"),
            N.tally(_bad_delivery()).alias("bad"),
        )
    )
    hours = (
        per_customer.join(customers.select("customer_id"), "customer_id", "left_semi")
        .groupBy("order_hour")
        .agg(
            N.half_up(N.ratio(F.sum("spent"), F.sum("paid"))).alias("avg_order_total"),
            F.sum("n").alias("order_cnt"),
            F.sum("late").alias("late_delivery_cnt"),
            F.sum("bad").alias("bad_delivery_related_fdbk_cnt"),
        )
        .withColumn("bad_delivery_related_fdbk_pct", N.percent("bad_delivery_related_fdbk_cnt", "late_delivery_cnt"))
    )
    # at most 24 rows from here on
    return hours.withColumns({
        "order_cnt_rnk": F.dense_rank().over(Window.orderBy(F.col("order_cnt").desc_nulls_last())),
        "bad_delivery_fdbk_pct_rnk": F.dense_rank().over(
            Window.orderBy(F.col("bad_delivery_related_fdbk_pct").desc_nulls_last())
        ),
    })


def delivery_by_distance_year(delivery: DataFrame) -> DataFrame:
    return delivery.groupBy("delivery_year", "delivery_distance_flag").agg(
        F.count(F.lit(1)).alias("order_cnt"),
        N.mean_rounded("delivery_time_minutes").alias("avg_delivery_timing"),
    )


def delivery_monthly_time(delivery: DataFrame) -> DataFrame:
    return delivery.groupBy("delivery_year", "delivery_month").agg(
        N.mean_rounded("delivery_time_minutes").alias("avg_delivery_time_in_minutes")
    )


def segment_bad_delivery(customers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Delivery complaints per customer segment; feedback is summed per customer first."""
    per_customer = feedback.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        N.tally(F.col("feedback_category") == L.DELIVERY).alias("about"),
        N.tally(_bad_delivery()).alias("bad"),
    )
    return (
        customers.select("customer_id", "customer_segment")
        .join(per_customer, "customer_id")
        .groupBy("customer_segment")
        .agg(
            F.sum("n").alias("count_of_orders"),
            F.sum("about").alias("delivery_related_reviews"),
            F.sum("bad").alias("neg_delivery_review"),
        )
        .withColumn("bad_delivery_review_pct", N.whole_percent("neg_delivery_review", "count_of_orders"))
    )


def share_by(df: DataFrame, key: str, counted: str, count_name: str, share_name: str) -> DataFrame:
    """Rows per label of a column and their percentage of all counted rows."""
    groups = df.groupBy(key).agg(F.count(counted).alias(count_name))
    share = F.try_divide(F.col(count_name) * 100.0, _overall(count_name))
    return groups.withColumn(share_name, N.half_up(share, 6))


def delay_reason_share(delivery: DataFrame) -> DataFrame:
    return share_by(delivery, "reasons_if_delayed", "order_id", "delivery_count", "reasons")


def _traffic(delivery: DataFrame) -> DataFrame:
    return delivery.filter(F.col("reasons_if_delayed") == L.TRAFFIC)


def traffic_delay_monthly(delivery: DataFrame) -> DataFrame:
    return share_by(
        _traffic(delivery), "delivery_month", "reasons_if_delayed", "traffic_delay_cnt", "bad_delivery_total_pct"
    )


def traffic_delay_weekly(delivery: DataFrame) -> DataFrame:
    """Mean order id per ISO week, as its readers expect, with the count they mean."""
    return _traffic(delivery).groupBy("delivery_week").agg(
        N.half_up(N.mean(F.col("order_id").cast("decimal(20,0)")), 6).alias("avg_delivery_cnt"),
        F.count(F.lit(1)).alias("traffic_delay_cnt"),
    )


def reason_avg_time(delivery: DataFrame) -> DataFrame:
    return delivery.groupBy("reasons_if_delayed").agg(
        N.mean_rounded("delivery_time_minutes", 6).alias("avg_late_timing"),
        F.count("order_id").alias("delivery_cnt"),
    )


def partner_delivery_count(delivery: DataFrame) -> DataFrame:
    return delivery.groupBy("delivery_partner_id").agg(F.count(F.lit(1)).alias("delivery_count"))


def distance_share(delivery: DataFrame) -> DataFrame:
    return share_by(
        delivery, "delivery_distance_flag", "order_id", "total_delivery_count", "pct_to_total_delivery"
    )


def gap_flag_count(orders: DataFrame) -> DataFrame:
    return orders.groupBy("delivery_gap_flag").agg(F.count("order_id").alias("order_count"))
