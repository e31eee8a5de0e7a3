"""What customers complain about, when, and what it costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.functions.timeline import carried, slice_hot_keys, with_next
from aislelens.operators.delivery import share_by


def _is(sentiment: str) -> Column:
    return F.col("sentiment") == sentiment


def _reviewed_orders(orders: DataFrame, feedback: DataFrame, order_cols: list[str], feedback_cols: list[str]) -> DataFrame:
    return orders.select("order_id", *order_cols).join(feedback.select("order_id", *feedback_cols), "order_id")


def monthly_negative_rank(feedback: DataFrame) -> DataFrame:
    """Categories ranked by negative feedback within each month."""
    month = Window.partitionBy("feedback_month")
    cells = feedback.groupBy(cal.month_start("feedback_date").alias("feedback_month"), "feedback_category").agg(
        F.count(F.lit(1)).alias("feedback_cnt"),
        F.count(F.when(_is(L.NEGATIVE), F.col("order_id"))).alias("negative_rev_cnt"),
    )
    return cells.withColumn("total_order_cnt", F.sum("feedback_cnt").over(month)).withColumns({
        "neg_to_category_fdbk_ratio": N.percent("negative_rev_cnt", "feedback_cnt"),
        "neg_to_monthly_total_fdbk_ratio": N.percent("negative_rev_cnt", "total_order_cnt"),
        "neg_rev_rank": F.dense_rank().over(month.orderBy(F.col("negative_rev_cnt").desc_nulls_last())),
    })


def negative_rank_frequency(ranked: DataFrame) -> DataFrame:
    """How many months each category took each rank."""
    return ranked.groupBy("feedback_category", "neg_rev_rank").agg(
        F.count(F.lit(1)).alias("num_of_first_ranks")
    )


def monthly_delivery_review(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    reviewed = _reviewed_orders(
        orders, feedback, ["order_month"], ["feedback_id", "sentiment", "feedback_category"]
    )
    bad_delivery = _is(L.NEGATIVE) & (F.col("feedback_category") == L.DELIVERY)
    return reviewed.groupBy("order_month").agg(
        F.count(F.lit(1)).alias("order_cnt"),
        F.count("feedback_id").alias("feedback_cnt"),
        N.tally(_is(L.NEGATIVE)).alias("neg_rev_cnt"),
        N.tally(bad_delivery).alias("neg_rev_for_delivery_cnt"),
    ).withColumns({
        "neg_delivery_review_pct": N.percent("neg_rev_for_delivery_cnt", "neg_rev_cnt"),
        "neg_delivery_fdbk_to_all_order_pct": N.percent("neg_rev_for_delivery_cnt", "order_cnt"),
    })


def monthly_feedback_ratio(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    reviewed = _reviewed_orders(orders, feedback, ["order_date"], ["feedback_id", "sentiment"])
    months = reviewed.groupBy(cal.month_start("order_date").alias("order_month")).agg(
        F.count("order_id").alias("total_order"),
        F.count("feedback_id").alias("_all"),
        N.tally(_is(L.NEGATIVE)).alias("_bad"),
        N.tally(_is(L.NEUTRAL)).alias("_neutral"),
        N.tally(~F.col("sentiment").isin(L.NEUTRAL, L.NEGATIVE)).alias("_good"),
    )
    before = F.lag("total_order").over(Window.orderBy("order_month"))  # one row per month
    return months.select(
        "order_month", "total_order",
        N.growth("total_order", before).alias("order_cnt_growth"),
        N.percent("_bad", "_all").alias("bad_feedback_rate"),
        N.percent("_neutral", "_all").alias("neutral_feedback_rate"),
        N.percent("_good", "_all").alias("good_feedback_rate"),
    )


def churn_after_bad_review(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    """Customers whose last reviewed order was reviewed badly, per month of that order."""
    timeline = slice_hot_keys(orders.select("order_id", "customer_id", "order_date", *carried(orders)), ["customer_id"], "order_date")
    reviewed = timeline.join(feedback.select("order_id", "feedback_id", "sentiment"), "order_id")
    followed = with_next(
        reviewed, ["customer_id"], ["order_date", "order_id", "feedback_id"], {"next_date": "order_date"}
    )
    lost = F.col("next_date").isNull() & _is(L.NEGATIVE)
    per_customer = followed.groupBy(cal.month_start("order_date").alias("order_month"), "customer_id").agg(
        N.tally(lost).alias("lost")
    )
    return per_customer.groupBy("order_month").agg(
        F.count("customer_id").alias("total_customer_cnt"), F.sum("lost").alias("customer_churn_cnt")
    ).withColumn("churn_pct", N.percent("customer_churn_cnt", "total_customer_cnt"))


def bad_review_reasons(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    """Order value and delivery time by sentiment, per customer and feedback category."""
    reviewed = _reviewed_orders(
        orders, feedback, ["customer_id", "order_total", "delivery_gap_in_minutes"],
        ["feedback_category", "sentiment"],
    )
    means = [
        N.mean_rounded(F.when(_is(s), F.col(column)), 6).alias(f"{name}_{s}_feedback")
        for s in (L.NEGATIVE, L.NEUTRAL, L.POSITIVE)
        for name, column in (("aov", "order_total"), ("delivery_gap", "delivery_gap_in_minutes"))
    ]
    return reviewed.groupBy("customer_id", "feedback_category").agg(
        F.count("order_id").alias("total_order_cnt"), *means
    )


def worst_category_per_month(orders: DataFrame, customers: DataFrame, feedback: DataFrame) -> DataFrame:
    reviewed = _reviewed_orders(
        orders, feedback, ["customer_id", "order_date"], ["rating", "feedback_category", "sentiment"]
    )
    per_customer = reviewed.groupBy(
        "customer_id", cal.month_start("order_date").alias("order_month"), "feedback_category"
    ).agg(
        F.sum("rating").alias("stars"), F.count("rating").alias("rated"),
        F.count(F.lit(1)).alias("n"), N.tally(_is(L.NEGATIVE)).alias("bad"),
    )
    cells = (
        per_customer.join(customers.select("customer_id"), "customer_id", "left_semi")
        .groupBy("order_month", "feedback_category")
        .agg(
            N.half_up(N.ratio(F.sum("stars"), F.sum("rated"))).alias("avg_rating"),
            F.sum("n").alias("total_fdbk_received"),
            F.sum("bad").alias("neg_fdbk_cnt"),
        )
    )
    worst = Window.partitionBy("order_month").orderBy(F.col("neg_fdbk_cnt").desc_nulls_last())
    return cells.withColumn("neg_fdbk_rnk", F.dense_rank().over(worst)).filter("neg_fdbk_rnk <= 1")


def area_negative_feedback(orders: DataFrame, customers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Negative feedback per area and category, counted per customer before the join."""
    bad = feedback.filter(_is(L.NEGATIVE))
    per_customer = (
        _reviewed_orders(orders, bad, ["customer_id"], ["feedback_category", "sentiment"])
        .groupBy("customer_id", "feedback_category", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_customer.join(customers.select("customer_id", "area"), "customer_id")
        .groupBy("area", "feedback_category", "sentiment")
        .agg(F.sum("n").alias("feedbk_size"))
    )


def product_quality_sentiment(
    items: DataFrame, products: DataFrame, feedback: DataFrame, orders: DataFrame
) -> DataFrame:
    """Per product name, the sentiment whose reviewed orders are worth most on average."""
    quality = feedback.filter(F.col("feedback_category") == L.PRODUCT_QUALITY)
    reviewed = (
        quality.select("order_id", "sentiment", "rating")
        .join(items.select("order_id", "product_id"), "order_id")
        .join(orders.select("order_id", "order_total"), "order_id")
        .join(products.select("product_id", "product_name"), "product_id")
    )
    cells = reviewed.groupBy("product_name", "sentiment").agg(
        N.mean_rounded("order_total").alias("avg_order_value"),
        F.count(F.lit(1)).alias("fdbk_received"),
        N.mean_rounded("rating").alias("avg_rating"),
    )
    # a product has one row per sentiment here
    product = Window.partitionBy("product_name")
    return (
        cells.withColumn(
            "most_fdbk_received_rnk",
            F.dense_rank().over(product.orderBy(F.col("fdbk_received").desc_nulls_last())),
        )
        .withColumn("_best", F.max("avg_order_value").over(product))
        .filter("avg_order_value = _best")
        .drop("_best")
    )


def sentiment_share(feedback: DataFrame) -> DataFrame:
    return share_by(feedback, "sentiment", "feedback_id", "count", "feedback_share_pct")


def category_avg_rating(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_category").agg(N.mean_rounded("rating", 6).alias("avg_rating"))


def rating_share(feedback: DataFrame) -> DataFrame:
    return share_by(feedback, "rating", "feedback_id", "rating_count", "rating_share")


def year_sentiment_count(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback_year", "sentiment").agg(F.count(F.lit(1)).alias("sentimental_count"))
