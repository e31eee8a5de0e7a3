"""Products and categories: contribution, margins, rankings, order-value audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.functions.order_statistics import with_quantiles
from aislelens.functions.timeline import slice_if_large, with_position


def _sold(orders: DataFrame, items: DataFrame, *columns: str | Column, how: str = "inner") -> DataFrame:
    return orders.select("order_id", "order_total", *columns).join(
        items.select("order_id", "product_id"), "order_id", how
    )


def _value_parts() -> list[Column]:
    """Partial figures from which a count, a sum and an average can be finished later."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("order_total").alias("value"),
        F.count("order_total").alias("paid"),
    ]


def _aov() -> Column:
    return N.half_up(N.ratio(F.sum("value"), F.sum("paid")))


def monthly_category_contribution(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Category figures per month beside the month's own, with both shares ranked."""
    cells = (
        _sold(orders, items, cal.month_start("order_date").alias("order_month"))
        .groupBy("product_id", "order_month").agg(*_value_parts())
        .join(products.select("product_id", "category"), "product_id")
        .groupBy("order_month", "category")
        .agg(F.sum("n").alias("order_cnt"), _aov().alias("aov"), N.total("value").alias("order_total_value"))
    )
    months = orders.groupBy(cal.month_start("order_date").alias("order_month")).agg(
        F.count(F.lit(1)).alias("order_count_mth"),
        N.mean_rounded("order_total").alias("monthly_aov"),
        N.total("order_total").alias("mth_total_order_value"),
    )
    by_value, by_count = "monthly_order_value_contribution_pct", "mthly_total_order_count_contribution_pct"
    month = Window.partitionBy("order_month")
    return cells.join(months, "order_month", "left").withColumns({
        by_count: N.percent("order_cnt", "order_count_mth"),
        by_value: N.percent("order_total_value", "mth_total_order_value"),
    }).withColumns({
        "monthly_order_value_cont_rank": F.dense_rank().over(month.orderBy(F.col(by_value).desc_nulls_last())),
        "monthly_order_count_cont_rank": F.dense_rank().over(month.orderBy(F.col(by_count).desc_nulls_last())),
    })


def _per_product(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order figures per product, keeping orders without an item under a NULL product."""
    return _sold(orders, items, how="left").groupBy("product_id").agg(*_value_parts())


def _weighted(column: str) -> Column:
    """Mean of a product attribute over orders, from one row per product."""
    known = F.when(F.col(column).isNotNull(), F.col("n"))
    return N.ratio(F.sum(F.col(column) * F.col("n")), F.sum(known))


def margin_tier_summary(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    priced = _per_product(orders, items).join(
        products.select(F.col("product_id").alias("known_id"), "category", "mrp", "margin_percentage"),
        F.col("product_id") == F.col("known_id"), "left",
    )
    tier = priced.groupBy("margin_percentage", "category").agg(
        F.count("known_id").alias("products"), *[
            e.alias(a) for a, e in {
                "n": F.sum("n"), "value": F.sum("value"), "paid": F.sum("paid"),
                "mrp_sum": F.sum(F.col("mrp") * F.col("n")),
                "mrp_n": F.sum(F.when(F.col("mrp").isNotNull(), F.col("n"))),
            }.items()
        ],
    )
    mrp = N.ratio(F.sum("mrp_sum"), F.sum("mrp_n"))
    return tier.groupBy("margin_percentage").agg(
        F.count("category").alias("category_cnt"),
        F.sum("products").alias("prod_cnt"),
        F.sum("n").alias("order_cnt"),
        N.half_up(mrp).alias("avg_mrp"),
        _aov().alias("aov"),
        N.percent(mrp, N.ratio(F.sum("value"), F.sum("paid"))).alias("avg_mrp_to_order_value_ratio"),
    )


def margin_product(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    priced = _per_product(orders, items).join(
        products.select("product_id", "category", "product_name", "price", "mrp", "margin_percentage"),
        "product_id", "left",
    )
    return priced.groupBy("margin_percentage", "category", "product_name").agg(
        F.sum("n").alias("order_cnt"),
        N.half_up(_weighted("price")).alias("avg_price"),
        N.half_up(_weighted("mrp")).alias("avg_mrp"),
        _aov().alias("aov"),
    )


def margin_category_rollup(per_product: DataFrame) -> DataFrame:
    """Unweighted means of the per-product averages."""
    return per_product.groupBy("margin_percentage", "category").agg(
        F.sum("order_cnt").alias("total_order_cnt"),
        N.half_up(F.avg("avg_price")).alias("avg_price"),
        N.half_up(F.avg("avg_mrp")).alias("avg_mrp"),
        N.half_up(F.avg("aov")).alias("avg_aov"),
    )


def area_product_rank(
    orders: DataFrame, items: DataFrame, products: DataFrame, customers: DataFrame
) -> DataFrame:
    """Products ordered more than once in an area, ranked there by average order value.

    An area has as many rows as there are products at most. The ranking in a large catalogue
    is sliced by cent, so that one area is not sorted by one task even though averages of many
    orders lie close together. Products without any order value come last.
    """
    worth = N.ratio("value", "paid")
    catalogue = products.agg(F.count("product_id")).scalar()
    cells = (
        _sold(orders, items, "customer_id")
        .join(customers.select("customer_id", "area"), "customer_id")
        .groupBy("area", "product_id").agg(*_value_parts())
        .filter("n > 1")
        .join(products.select("product_id", "product_name"), "product_id")
        .withColumns({"order_size": F.col("n"), "aov": N.half_up(worth), "_worth": -N.half_up(worth, 6)})
    )
    sliced = slice_if_large(cells, catalogue, F.coalesce(F.floor(F.col("_worth") * 100), F.lit(2**62)))
    return with_position(sliced, ["area"], ["_worth"], "aov_rnk", dense=True).select(
        "area", "product_id", "product_name", "order_size", "aov", "aov_rnk"
    )


def product_contribution(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue per product name and its share of the revenue of all orders."""
    everything = orders.agg(F.sum("order_total")).scalar()
    named = _sold(orders, items).groupBy("product_id").agg(*_value_parts()).join(
        products.select("product_id", "product_name"), "product_id"
    )
    return named.groupBy("product_name").agg(
        N.total("value").alias("total_order_value"),
        N.percent(F.sum("value"), everything).alias("contribution_pct"),
    )


def _monthly_value(orders: DataFrame, items: DataFrame, products: DataFrame, label: str) -> DataFrame:
    """Orders and value per calendar month and product label, all years together."""
    return (
        _sold(orders, items, F.month("order_date").alias("order_month"))
        .groupBy("product_id", "order_month").agg(*_value_parts())
        .join(products.select("product_id", label), "product_id")
        .groupBy("order_month", label)
        .agg(F.sum("n").alias("order_size"), N.total("value").alias("total_order_value"))
    )


def _best(by: str = "order_month") -> Column:
    return F.dense_rank().over(Window.partitionBy(by).orderBy(F.col("total_order_value").desc_nulls_last()))


def monthly_top_products(
    orders: DataFrame, items: DataFrame, products: DataFrame, n: int = 5
) -> DataFrame:
    """The n best products of each calendar month; shares are of all products' totals."""
    cells = _monthly_value(orders, items, products, "product_name")
    months = cells.groupBy("order_month").agg(
        F.sum("order_size").alias("_count"), F.sum("total_order_value").alias("_value")
    )
    top = cells.withColumn("order_value_rnk", _best()).filter(F.col("order_value_rnk") <= n)
    return top.join(months, "order_month").select(
        "order_month", "product_name", "order_size", "total_order_value", "order_value_rnk",
        N.percent("order_size", "_count").alias("order_size_contribution_to_monthly_total_order_size"),
        N.percent("total_order_value", "_value").alias("order_value_contribution_to_monthly_total_order_value"),
    )


def monthly_top_tally(
    orders: DataFrame, items: DataFrame, products: DataFrame, label: str, n: int
) -> DataFrame:
    """In how many calendar months a product or category is among the n best."""
    cells = _monthly_value(orders, items, products, label)
    top = cells.withColumn("order_value_rnk", _best()).filter(F.col("order_value_rnk") <= n)
    return top.groupBy(label).agg(F.count(F.lit(1)).alias("repetition_size"))


def monthly_top3_category_tally(orders: DataFrame, items: DataFrame, products: DataFrame, n: int = 3) -> DataFrame:
    return monthly_top_tally(orders, items, products, "category", n)


def best_selling_product(items: DataFrame, products: DataFrame, n: int = 1) -> DataFrame:
    """The product with most units sold; the lower product id wins a tie."""
    sold = items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("order_frequency"), F.sum("quantity").alias("total_quantities_sold")
    )
    return (
        sold.join(products.select("product_id", "product_name"), "product_id")
        .orderBy(F.col("total_quantities_sold").desc_nulls_last(), "product_id")
        .limit(n)
        .select("product_id", "product_name", "order_frequency", "total_quantities_sold")
    )


def order_value_ratio(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Per order: charged value, quantity times unit price, and their ratio.

    Lines are summed per order before the order is joined; the order's total counts once
    per line, as a join of the two would have it.
    """
    lines = (
        items.join(products.select("product_id"), "product_id", "left_semi")
        .groupBy("order_id")
        .agg(
            F.sum("quantity").alias("total_quantities_sold"),
            F.sum("unit_price").alias("_price"),
            F.count(F.lit(1)).alias("_lines"),
        )
    )
    calculated = F.col("total_quantities_sold") * F.col("_price")
    given = F.col("order_total") * F.col("_lines")
    return orders.select("order_id", "order_total").join(lines, "order_id").select(
        "order_id",
        "total_quantities_sold",
        N.half_up(calculated).alias("calc_order_value"),
        given.cast("decimal(38,2)").alias("given_order_value"),
        N.half_up(N.ratio(given, calculated)).alias("calc_to_given_order_value_ratio"),
    )


def order_value_audit(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    ratio = order_value_ratio(orders, items, products)
    kind = L.band("calc_to_given_order_value_ratio", L.ORDER_VALUE_BANDS, L.ORDER_VALUE_OTHER)
    kinds = ratio.groupBy(kind.alias("outlier_classification")).agg(F.count(F.lit(1)).alias("row_cnts"))
    return kinds.withColumn(
        "pct_of_outlier_portions", N.percent("row_cnts", F.sum("row_cnts").over(Window.partitionBy()))
    )


def order_value_ratio_extremes(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    ratio = F.col("calc_to_given_order_value_ratio")
    return order_value_ratio(orders, items, products).agg(
        F.min(ratio).alias("minimum_level_outlier"), F.max(ratio).alias("maximum_level_outlier")
    )


def valid_orders_filter(
    orders: DataFrame, items: DataFrame, products: DataFrame, low: float = 0.5, high: float = 1.25
) -> DataFrame:
    """Orders charged strictly between ``low`` and ``high`` times their list value."""
    ratio = F.col("calc_to_given_order_value_ratio")
    return order_value_ratio(orders, items, products).filter((ratio > low) & (ratio < high))


def iqr_inliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows strictly inside the quartiles widened by k interquartile ranges."""
    q1, q3 = F.col("q1"), F.col("q3")
    limited = with_quantiles(df, column, {"q1": 0.25, "q3": 0.75}).withColumn("iqr", q3 - q1)
    limited = limited.withColumns({"lower_bound": q1 - k * F.col("iqr"), "upper_bound": q3 + k * F.col("iqr")})
    inside = limited.filter((F.col(column) > F.col("lower_bound")) & (F.col(column) < F.col("upper_bound")))
    return inside.select(*[F.col(f"`{c}`") for c in df.columns], "q1", "q3", "lower_bound", "upper_bound", "iqr")


def category_avg_mrp(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(N.mean_rounded("mrp").alias("mrp"))


def category_stock_value(products: DataFrame) -> DataFrame:
    """What holding the minimum stock costs on average, per category."""
    means = products.groupBy("category").agg(
        N.mean("min_stock_level").alias("stock"), N.mean("price").alias("price")
    )
    return means.select(
        "category", N.half_up("stock").alias("avg_min_stock"), N.half_up("price").alias("avg_price"),
        N.half_up(F.col("stock") * F.col("price")).alias("avg_maintaining_stock_value"),
    )


def item_count_by_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(F.count(F.lit(1)).alias("count"))
