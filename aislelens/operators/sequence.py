"""What a customer buys next: product and category sequences along the order timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import numeric as N
from aislelens.functions.timeline import HOT, SLICE, add_slices, carried, deal_slices, mark_hot_keys, slice_hot_keys, with_next

ORDER = ["order_date", "order_id", "product_id"]


def purchase_lines(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    customers: DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Order lines with product name and category, for known customers if given.

    They are sliced for lookups along each customer's timeline, which is decided on the
    orders alone, before any join.
    """
    narrow = orders.select("order_id", "customer_id", "order_date", "order_total", *carried(orders))
    lines = (
        slice_hot_keys(narrow, ["customer_id"], "order_date")
        .join(items.select("order_id", "product_id"), "order_id", how)
        .join(products.select("product_id", "product_name", "category"), "product_id", how)
    )
    if customers is not None:
        lines = lines.join(customers.select("customer_id"), "customer_id", "left_semi")
    return lines


def _followed(lines: DataFrame, take: dict[str, str], order: list[str] = ORDER) -> DataFrame:
    return with_next(lines, ["customer_id"], order, take)


def next_product_symmetry(
    orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame
) -> DataFrame:
    """Product pairs bought in both directions, and the revenue difference between them."""
    lines = purchase_lines(orders, items, products, customers).select(
        "customer_id", HOT, SLICE, "order_date", F.col("product_name").alias("curr_product"), "order_total"
    ).distinct()
    steps = _followed(
        lines, {"next_product": "curr_product", "next_total": "order_total"}, ["order_date", "curr_product", "order_total"]
    )
    # both directions of a pair meet in one group, so the pairs need no join with themselves
    forward = F.col("curr_product") > F.col("next_product")
    revenue = F.col("order_total") + F.col("next_total")
    x, y = F.greatest("curr_product", "next_product"), F.least("curr_product", "next_product")
    return (
        steps.filter(F.col("curr_product") != F.col("next_product"))
        .groupBy(x.alias("item_x"), y.alias("item_y"))
        .agg(
            F.count_if(forward).alias("x_to_y_count"), N.mean_rounded(F.when(forward, revenue)).alias("x_to_y_avg_revenue"),
            F.count_if(~forward).alias("y_to_x_count"), N.mean_rounded(F.when(~forward, revenue)).alias("y_to_x_avg_revenue"),
        )
        .filter("x_to_y_count > 1 and y_to_x_count > 1")
        .select(
            "item_x", "item_y", "x_to_y_count", "x_to_y_avg_revenue",
            F.col("item_y").alias("item_x_reverse"), F.col("item_x").alias("item_y_reverse"), "y_to_x_count", "y_to_x_avg_revenue",
            N.half_up(F.col("x_to_y_avg_revenue") - F.col("y_to_x_avg_revenue")).alias("avg_revenue_gap"),
        )
    )


def next_category_propensity(
    orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame
) -> DataFrame:
    """Category to next category, ranked by average revenue within the current category."""
    both = F.col("order_total") + F.col("next_total")
    by_revenue = Window.partitionBy("curr_category").orderBy(F.col("_revenue").desc_nulls_last())
    lines = purchase_lines(orders, items, products, customers)
    return (
        _followed(lines, {"next_category": "category", "next_total": "order_total"})
        .filter("next_category is not null")
        .groupBy(F.col("category").alias("curr_category"), "next_category")
        .agg(
            F.count(F.lit(1)).alias("pair_ordering_size"),
            N.mean_rounded(both).alias("avg_revenue_per_pair"),
            N.mean_rounded(both, 6).alias("_revenue"),
        )
        .filter("pair_ordering_size > 1")
        .withColumn("revenue_rank", F.dense_rank().over(by_revenue))
        .drop("_revenue")
    )


def next_category_top(propensity: DataFrame) -> DataFrame:
    return propensity.filter("revenue_rank = 1")


def next_category_demand(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """How often, and for how much, each category is the next one bought."""
    lines = purchase_lines(orders, items, products, how="left")
    return (
        _followed(lines, {"next_category": "category", "next_total": "order_total"})
        .filter("next_category is not null")
        .groupBy("next_category")
        .agg(
            F.count(F.lit(1)).alias("next_order_cnt"),
            N.total("next_total").alias("tov_for_next_category"),
            N.mean_rounded("next_total").alias("aov_for_next_category"),
        )
    )


def _pair_value(lines: DataFrame, label: str, current: str, following: str) -> DataFrame:
    return (
        _followed(lines, {following: label, "next_total": "order_total"})
        .filter(F.col(following).isNotNull())
        .groupBy(F.col(label).alias(current), following)
        .agg(
            F.count(F.lit(1)).alias("txn_cnt"),
            F.count("next_total").alias("_valued"),
            N.total(F.col("order_total") + F.col("next_total")).alias("total_order_value"),
        )
    )


def next_product_value(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    lines = purchase_lines(orders, items, products, customers)
    return _pair_value(lines, "product_name", "curr_prod_txn", "nxt_prod_txn").drop("_valued")


def next_category_value(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """As for products, but a next order without a total does not count."""
    lines = purchase_lines(orders, items, products, customers)
    pairs = _pair_value(lines, "category", "curr_category", "next_category")
    return pairs.filter("_valued > 0").withColumn("txn_cnt", F.col("_valued")).drop("_valued")


def triple_repeat_product(
    orders: DataFrame, items: DataFrame, customers: DataFrame, products: DataFrame
) -> DataFrame:
    """Customers who bought the same product three orders running."""
    second = _followed(purchase_lines(orders, items, products, customers), {"snd_purchase": "product_name"})
    # the row after next is the next row's successor; the second lookup keeps the
    # partitioning and order of the first
    third = _followed(second, {"trd_purchase": "snd_purchase"})
    return third.filter("product_name = snd_purchase and trd_purchase = snd_purchase").select(
        "customer_id", F.col("product_name").alias("fst_purchase"), "snd_purchase", "trd_purchase"
    )


def same_product_gap(
    orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame
) -> DataFrame:
    """Repeat purchases of a product by a customer: each purchase time with the next one.

    ``purchases`` and ``next_purchases`` count the order lines at both times; the pairs
    between any two times are the product of their counts.

    Day gaps add up along the timeline, so the gap between any two purchases is the
    difference of their ``days_since_first``; listing every pair, which grows with the
    square of a customer's purchases, is not needed to know them all.
    """
    bought = (
        orders.select("order_id", "customer_id", "order_date")
        .join(items.select("order_id", "product_id"), "order_id")
        .join(customers.select("customer_id"), "customer_id", "left_semi")
    )
    moments = bought.groupBy("customer_id", "product_id", "order_date").agg(
        F.count(F.lit(1)).alias("purchases")
    )
    repeated = (
        moments.groupBy("customer_id", "product_id")
        .agg(F.min("order_date").alias("_first"), F.max("order_date").alias("_last"))
        .filter("_first < _last")
        .drop("_last")
    )
    pair = ["customer_id", "product_id"]
    sliced = deal_slices(slice_hot_keys(moments.join(repeated, pair), pair, "order_date"), pair)
    return (
        with_next(sliced, pair, ["order_date"], {"next_buying_date": "order_date", "next_purchases": "purchases"})
        .filter("next_buying_date is not null")
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "customer_id", "product_id", "product_name",
            F.col("order_date").alias("first_buying_date"), "next_buying_date",
            cal.calendar_days("order_date", "next_buying_date").alias("order_day_gap"),
            cal.calendar_days("_first", "order_date").alias("days_since_first"),
            "purchases", "next_purchases",
        )
    )


def product_reorder_gap(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Floor of the mean whole-day gap between consecutive orders of a product by anyone."""
    marked = mark_hot_keys(items.select("order_id", "product_id"), ["product_id"])
    sold = add_slices(marked.join(orders.select("order_id", "order_date"), "order_id"), "order_date")
    gaps = with_next(sold, ["product_id"], ["order_date", "order_id"], {"next_date": "order_date"})
    days = cal.whole_days_between("order_date", "next_date")
    per_product = gaps.groupBy("product_id").agg(F.sum(days).alias("days"), F.count(days).alias("n"))
    return per_product.join(products.select("product_id", "product_name"), "product_id").select(
        "product_id", "product_name",
        F.call_function("div", F.col("days"), F.nullif(F.col("n"), F.lit(0))).alias("avg_day_gap"),
    )
