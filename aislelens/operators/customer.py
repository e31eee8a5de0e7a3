"""Customer value: RFM scores and segments, lifetime value, baskets, repeat purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.functions.order_statistics import with_tiles


def spending(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        cal.day_of(F.max("order_date")).alias("last_day"),
        F.count("order_id").alias("frequency"),
        F.sum("order_total").alias("monetary"),
    )


def _recency(spending: DataFrame) -> DataFrame:
    """Days between a customer's last order and the last order of all."""
    newest = spending.agg(F.max("last_day")).scalar()
    return spending.withColumn("recency", F.date_diff(newest, F.col("last_day")))


def rfm_fixed_bins(
    orders: DataFrame,
    customers: DataFrame,
    recency: list[L.Band] = L.RECENCY_BANDS,
    frequency: list[L.Band] = L.FREQUENCY_BANDS,
    monetary: list[L.Band] = L.MONETARY_BANDS,
) -> DataFrame:
    return rfm_bins_of(spending(orders), customers, recency, frequency, monetary)


def rfm_bins_of(
    spending: DataFrame,
    customers: DataFrame,
    recency: list[L.Band] = L.RECENCY_BANDS,
    frequency: list[L.Band] = L.FREQUENCY_BANDS,
    monetary: list[L.Band] = L.MONETARY_BANDS,
) -> DataFrame:
    """The bins from one row per customer, as ``spending`` gives or a merged state holds it."""
    everyone = spending.agg(F.count("customer_id")).scalar()
    known = _recency(spending).join(customers.select("customer_id"), "customer_id", "left_semi")
    scored = known.withColumns({
        "r_score": L.band("recency", recency, L.SCORE_OTHER),
        "f_score": L.band("frequency", frequency, L.SCORE_OTHER),
        "m_score": L.band("monetary", monetary, L.SCORE_OTHER),
    })
    bins = scored.groupBy("r_score", "f_score", "m_score").agg(
        N.mean_rounded("recency").alias("avg_recency"),
        N.mean_rounded("frequency").alias("avg_frequency"),
        N.mean_rounded("monetary").alias("avg_monetary"),
        F.count(F.lit(1)).alias("cust_cnt"),  # one row per customer already
    )
    return bins.select(
        "r_score", "f_score", "m_score",
        (F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")).alias("rfm_bins"),
        "avg_recency", "avg_frequency", "avg_monetary", "cust_cnt",
        N.percent("cust_cnt", everyone).alias("cust_size_pct"),
    )


def rfm_lapsed_vs_active(rfm: DataFrame) -> DataFrame:
    """Mean of the bins' average spend: lapsed (recency score 5) against all others."""
    lapsed = F.col("r_score") == 5
    both = rfm.agg(
        N.half_up(F.avg(F.when(lapsed, F.col("avg_monetary")))).alias("lapsed"),
        N.half_up(F.avg(F.when(~lapsed, F.col("avg_monetary")))).alias("active"),
    )
    return both.unpivot([], ["lapsed", "active"], "segment", "avg_monetary")


def rfm_ntile_segments(orders: DataFrame, customers: DataFrame, tiles: int = 5) -> DataFrame:
    """Segments from recency bands and exact quintiles of frequency and spend.

    The first customer of each quintile is found by counting, so no task ever sorts all
    customers.
    """
    rfm = _recency(spending(orders)).join(customers.select("customer_id"), "customer_id", "left_semi")
    scored = rfm.withColumn(
        "recency_score", L.band("recency", L.RECENCY_QUINTILE_BANDS, L.RECENCY_QUINTILE_OTHER)
    )
    scored = with_tiles(scored, tiles, {m: f"{m}_score" for m in ("frequency", "monetary")}, "customer_id")
    segment = F.lit(L.RFM_SEGMENT_OTHER)
    for r, f, m, label in reversed(L.RFM_SEGMENTS):
        meets = (F.col("recency_score") >= r) & (F.col("frequency_score") >= f) & (F.col("monetary_score") >= m)
        segment = F.when(meets, F.lit(label)).otherwise(segment)
    base = customers.agg(F.countDistinct("customer_id")).scalar()
    return scored.groupBy(segment.alias("rfm_segment")).agg(
        F.count("customer_id").alias("customer_count"),
        N.mean_rounded("frequency").alias("avg_buying_frequency"),
        N.mean_rounded("monetary").alias("avg_money_spend"),
    ).withColumn("cust_contribution_pct", N.percent("customer_count", base))


def customer_lifetime_value(
    orders: DataFrame, customers: DataFrame, feedback: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Spend, delivery and review figures per customer.

    By default each order is paired with each feedback of its customer, so counts and sums
    are multiplied by the number of feedbacks. Both sides are aggregated per customer
    first and the products taken on the totals: the pairs are never built.
    ``dedupe=True`` pairs an order only with its own feedback.
    """
    bad = F.col("sentiment") == L.NEGATIVE
    good_reviews = N.tally(F.col("sentiment") != L.NEGATIVE)
    bad_delivery = N.tally(bad & (F.col("feedback_category") == L.DELIVERY))
    money = F.col("order_total")
    late, ahead = F.col("delivery_gap_in_minutes"), F.col("gap_between_promised_actual_time")
    if dedupe:
        pairs = orders.join(
            feedback.select("order_id", "sentiment", "feedback_category"), "order_id"
        ).groupBy("customer_id").agg(
            F.count("order_id").alias("order_cnt"), F.sum(money).alias("spent"), N.mean(money).alias("aov"),
            N.mean(late).alias("late"), N.mean(ahead).alias("ahead"),
            good_reviews.alias("good"), bad_delivery.alias("bad"),
        )
    else:
        bought = orders.groupBy("customer_id").agg(
            F.count("order_id").alias("n"), F.sum(money).alias("spent1"), N.mean(money).alias("aov"),
            N.mean(late).alias("late"), N.mean(ahead).alias("ahead"),
        )
        reviewed = feedback.groupBy("customer_id").agg(
            F.count(F.lit(1)).alias("f"), good_reviews.alias("good1"), bad_delivery.alias("bad1")
        )
        pairs = bought.join(reviewed, "customer_id").select(
            "customer_id", (F.col("n") * F.col("f")).alias("order_cnt"),
            (F.col("spent1") * F.col("f")).alias("spent"), "aov", "late", "ahead",
            (F.col("good1") * F.col("n")).alias("good"), (F.col("bad1") * F.col("n")).alias("bad"),
        )
    return pairs.join(customers.select("customer_id", "customer_name"), "customer_id").select(
        "customer_id", "customer_name", "order_cnt",
        F.col("spent").cast("decimal(38,2)").alias("total_value_spent"),
        N.half_up("aov").alias("aov"),
        N.half_up("late").alias("avg_delivery_delay"),
        N.half_up("ahead").alias("avg_promised_actual_time"),
        N.percent("good", "order_cnt").alias("good_review_pct"),
        N.percent("bad", "order_cnt").alias("delivery_wise_bad_category_pct"),
    )


def customer_category_basket(
    orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Categories a customer bought more than once, with their value."""
    lines = (
        orders.select("order_id", "customer_id", "order_total")
        .join(items.select("order_id", "product_id"), "order_id")
        .join(products.select("product_id", "category"), "product_id")
    )
    baskets = lines.groupBy("customer_id", "category").agg(
        F.count(F.lit(1)).alias("order_size"), N.total("order_total").alias("order_value")
    ).filter("order_size > 1")
    return baskets.join(customers.select("customer_id", "customer_name"), "customer_id").select(
        "customer_id", "customer_name", "category", "order_size", "order_value"
    )


def repeat_customer_pct(orders: DataFrame) -> DataFrame:
    per_customer = orders.filter("customer_id is not null").groupBy("customer_id").agg(F.count("order_id").alias("n"))
    return per_customer.agg(
        N.whole_percent(F.count_if(F.col("n") > 1), F.count(F.lit(1))).alias("repeated_customer_pct")
    )


def customer_negative_review_pct(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    reviewed = orders.select("order_id", "customer_id").join(
        feedback.select("order_id", "sentiment"), "order_id"
    )
    return reviewed.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_frequency"),
        N.tally(F.col("sentiment") == L.NEGATIVE).alias("bad_review_orders"),
    ).filter("order_frequency > 1").withColumn(
        "bad_review_orders_pct", N.whole_percent("bad_review_orders", "order_frequency")
    )


def avg_negative_review_pct(orders: DataFrame, feedback: DataFrame) -> DataFrame:
    """Mean of the per-customer percentages, a single figure."""
    return customer_negative_review_pct(orders, feedback).agg(
        N.mean_rounded("bad_review_orders_pct").alias("avg_pct_of_bad_reviews")
    )


def repeat_product_customers(
    orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Products a customer bought more than once. Names are joined to the few survivors."""
    bought = orders.select("order_id", "customer_id").join(items.select("order_id", "product_id"), "order_id")
    repeated = bought.groupBy("customer_id", "product_id").agg(
        F.count(F.lit(1)).alias("size_count")
    ).filter("size_count > 1")
    return (
        repeated.join(customers.select("customer_id", "customer_name"), "customer_id")
        .join(products.select("product_id", "product_name"), "product_id")
        .select("customer_id", "customer_name", "product_id", "product_name", "size_count")
    )
