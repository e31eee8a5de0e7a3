"""Every registered analysis, bound to the tables of a dataset directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislelens.functions import labels as L
from aislelens.operators import cleaning, cohort, customer, delivery, feedback, growth, new_load, product, quality, sequence, state
from aislelens.sources import files, loads
from aislelens.sources.retail import RetailTables

Job = Callable[[RetailTables], DataFrame]

ORDER_FILE_SCHEMA = """order_id bigint, customer_id bigint, order_date timestamp_ntz,
promised_delivery_time timestamp_ntz, actual_delivery_time timestamp_ntz, order_total double,
payment_method string, delivery_partner_id int"""
FEEDBACK_COLUMNS = ["feedback_id", "order_id", "customer_id", "rating", "feedback_category", "sentiment", "feedback_date"]


# ---- jobs that need some preparation before the operator -----------------------------

def _orders_from_csv(t: RetailTables) -> DataFrame:
    path = files.shared_folder(t.spark, "orders-csv")
    files.write_csv(t.orders_raw, path)
    return files.load_csv(t.spark, path, ORDER_FILE_SCHEMA)


def _cleaned_to_csv(t: RetailTables) -> DataFrame:
    path = files.shared_folder(t.spark, "delivery-csv")
    cleaned = t.delivery.drop("delivery_week_period")
    files.write_csv(cleaned, path)
    return files.load_csv(t.spark, path, cleaned.schema)


def _append_in_two_loads(t: RetailTables) -> DataFrame:
    """The feedback table as it stands after two loads were appended to one target."""
    target = files.shared_folder(t.spark, "feedback-table")
    cleaned = t.feedback.select(*FEEDBACK_COLUMNS)
    negative = F.col("sentiment").eqNullSafe(L.NEGATIVE)
    files.load_append(cleaned.filter(negative), target)
    files.load_append(cleaned.filter(~negative), target)
    return t.spark.read.parquet(target)


def _loads_run_again(t: RetailTables) -> DataFrame:
    """The feedback table after two loads of which one had run before, with other rows."""
    target = files.shared_folder(t.spark, "feedback-loads")
    negative = F.col("sentiment").eqNullSafe(L.NEGATIVE)
    for name, rows in (("first", F.lit(True)), ("second", ~negative), ("first", negative)):
        loads.load(t.feedback.filter(rows), target, name, partition_by=["feedback_year", "feedback_month"])
    return loads.read_loads(t.spark, target).select(*FEEDBACK_COLUMNS, loads.LOAD)


def _state_of_loads(t: RetailTables) -> DataFrame:
    """The customers' state after two loads that share customers and months, the first of them run again."""
    target = files.shared_folder(t.spark, "customer-state")
    even = F.col("order_id") % 2 == 0
    for name, rows in (("even", F.lit(True)), ("odd", ~even), ("even", even)):
        state.add_load(t.orders.filter(rows), target, name)
    return state.stored(t.spark, target)


ORDER_PARTITION = ["order_year", "order_month"]
FILTER_PIECES = 4


def _repeats_of_new_orders(t: RetailTables) -> DataFrame:
    """Orders of a new load that the stored ones have already; months without a hit are not read."""
    key, stored = F.col("order_id"), t.orders.filter("order_id % 5 <> 0")
    filters = new_load.key_filters(stored, ["order_id"], ORDER_PARTITION, FILTER_PIECES)
    return new_load.repeated_keys(t.orders.filter(key % 7 == 0), stored, ["order_id"], filters, ORDER_PARTITION, FILTER_PIECES)


def _items_of_unknown_orders(t: RetailTables) -> DataFrame:
    """References of a new load of items to orders that were not loaded, with their rows."""
    stored = t.orders.filter("order_id % 5 <> 0")
    filters = new_load.key_filters(stored, ["order_id"], ORDER_PARTITION, FILTER_PIECES)
    new_items = t.items.filter("order_id % 3 = 0")
    return new_load.unknown_references(new_items, "order_id", stored, "order_id", filters, ORDER_PARTITION, FILTER_PIECES)


def _rejected_orders(t: RetailTables) -> DataFrame:
    """What a load of an orders file with spoiled records rejects, and why."""
    path, target = files.shared_folder(t.spark, "spoiled-csv"), files.shared_folder(t.spark, "orders-loads")
    key = F.col("order_id")
    spoiled = t.orders_raw.withColumns({
        "customer_id": F.when(key % 101 != 0, F.col("customer_id")),
        "order_total": F.when(key % 97 == 0, F.lit("n/a")).otherwise(F.col("order_total").cast("string")),
    })
    files.write_csv(spoiled, path)
    loads.load_files(t.spark, path, ORDER_FILE_SCHEMA, target, "first", rejects=f"{target}-rejects", required=["order_id", "customer_id"])
    rejected = loads.read_rejects(t.spark, f"{target}-rejects")
    return rejected.select(F.substring_index("record", ",", 1).cast("bigint").alias("order_id"), "reason", loads.LOAD)


def _dates_as_text(t: RetailTables) -> DataFrame:
    stamps = ["order_date", "promised_delivery_time", "actual_delivery_time"]
    text = t.orders_raw.select("order_id", *[F.col(c).cast("string").alias(c) for c in stamps])
    return cleaning.parse_dates(text, dict.fromkeys(stamps, cleaning.TIMESTAMP_FORMAT))


def _evolved_delivery(t: RetailTables) -> DataFrame:
    before = t.delivery.select(
        "order_id", "delivery_partner_id", "delivery_week", "delivery_week_period",
        F.col("delivery_distance_category").alias("distance_flag_dupl"),
    )
    return cleaning.schema_evolution(
        before,
        casts={"delivery_partner_id": "bigint", "delivery_week": "string"},
        renames={"distance_flag_dupl": "delivery_distance_category"},
        drops=["delivery_week_period", "store_id"],
    )


def _required(t: RetailTables) -> dict[str, tuple[DataFrame, list[str]]]:
    """Columns that must not be NULL."""
    return {
        "orders": (t.orders, ["order_id", "customer_id", "order_date"]),
        "customers": (t.customers, ["customer_id"]),
        "feedback": (t.feedback, ["feedback_id", "order_id", "customer_id", "feedback_date"]),
        "products": (t.products, ["product_id"]),
        "order_items": (t.items, ["order_id", "product_id"]),
        "delivery": (t.delivery, ["order_id"]),
    }


def _foreign_keys(t: RetailTables) -> DataFrame:
    return quality.fk_violations([
        ("orders_customer", t.orders, "customer_id", t.customers),
        ("feedback_customer", t.feedback, "customer_id", t.customers),
        ("feedback_order", t.feedback, "order_id", t.orders),
        ("items_product", t.items, "product_id", t.products),
        ("items_order", t.items, "order_id", t.orders),
        ("delivery_order", t.delivery, "order_id", t.orders),
    ])


def _lines_as_stored(t: RetailTables) -> DataFrame:
    """All stored order lines; unlike ``items`` their key repeats."""
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )


def _event_values(t: RetailTables) -> DataFrame:
    return t.raw("events").select("event_id", "value")


def _propensity(t: RetailTables) -> DataFrame:
    return sequence.next_category_propensity(t.timeline, t.items, t.customers, t.products)


JOBS: dict[str, Job] = {
    # sources, cleaning, sinks
    "load_csv": _orders_from_csv,
    "parse_dates": _dates_as_text,
    "order_enrich": lambda t: cleaning.order_enrich(t.orders_raw).select(
        "order_id", "delivery_gap_in_minutes", "gap_between_promised_actual_time"
    ),
    "delivery_gap_flag": lambda t: cleaning.delivery_gap_flag(cleaning.order_enrich(t.orders_raw)).select(
        "order_id", "delivery_gap_flag"
    ),
    "calendar_parts": lambda t: cleaning.calendar_parts(
        t.orders_raw.select("order_id", "order_date"), "order_date", "order"
    ),
    "calendar_parts_feedback": lambda t: t.feedback.select(
        "feedback_id", *[f"feedback_{n}" for n in cleaning.FEEDBACK_PARTS.values()]
    ),
    "calendar_parts_customers": lambda t: t.customers.select(
        "customer_id", "registration_year", "registration_month"
    ),
    "calendar_parts_delivery": lambda t: t.delivery.select(
        "order_id", *[f"delivery_{n}" for n in cleaning.DELIVERY_PARTS.values()]
    ),
    "normalise_text": lambda t: cleaning.normalise_text(
        t.products_raw.select("product_id", "product_name", "category"), ["product_name", "category"]
    ),
    "normalise_delay_reason": lambda t: cleaning.normalise_text(
        t.delivery_raw.select("order_id", "delivery_status", "reasons_if_delayed"),
        ["delivery_status"], {"reasons_if_delayed": L.REASON_SPELLINGS},
    ),
    "fill_missing_reason": lambda t: cleaning.fill_missing_reason(
        t.delivery_raw.select("order_id", "reasons_if_delayed")
    ),
    "distance_flag_closed_bands": lambda t: cleaning.distance_flag_closed_bands(
        t.delivery_raw.select("order_id", "distance_km")
    ),
    "distance_category_cumulative": lambda t: cleaning.distance_category_cumulative(
        t.delivery_raw.select("order_id", "distance_km")
    ),
    "product_profit": lambda t: cleaning.product_profit(t.products_raw).select(
        "product_id", F.col("profit").cast("double").alias("profit")
    ),
    "schema_evolution": _evolved_delivery,
    "load_append": _append_in_two_loads,
    "load_repeated": _loads_run_again,
    "load_rejects": _rejected_orders,
    "new_load_repeats": _repeats_of_new_orders,
    "new_load_unknown": _items_of_unknown_orders,
    "write_csv": _cleaned_to_csv,
    # data quality
    "row_counts": lambda t: quality.row_counts({
        "orders": t.orders, "customers": t.customers, "feedback": t.feedback,
        "products": t.products, "order_items": t.items, "delivery": t.delivery,
    }),
    "orphan_orders": lambda t: quality.orphan_orders(
        t.orders.select("order_id", "customer_id", "order_date", "payment_method"), t.customers, t.feedback
    ),
    "orphan_orders_of_known_parts": lambda t: quality.orphan_orders(
        t.orders.select("order_id", "customer_id", "order_date", "payment_method"),
        t.customers.filter("customer_id % 3 <> 0"), t.feedback.filter("order_id % 2 = 0"),
    ),
    "fk_violations": _foreign_keys,
    "dup_orders": lambda t: quality.duplicate_rank(t.orders, "order_id", "order_date", ["customer_id"]),
    "dup_customers": lambda t: quality.duplicate_rank(
        t.customers.withColumn("registration_date", F.col("registration_date").cast("timestamp_ntz")),
        "customer_id", "registration_date", ["customer_name"],
    ),
    "dup_feedback_customer": lambda t: quality.duplicate_rank(
        t.feedback, "customer_id", "feedback_date", ["feedback_id"]
    ),
    "pk_violations": lambda t: quality.pk_violations(_lines_as_stored(t), ["order_id", "line_number"]),
    "dup_feedback_dates": lambda t: quality.dup_feedback_dates(t.feedback),
    "dup_customer_orders": lambda t: quality.dup_customer_orders(t.orders, t.customers),
    "dup_order_items": lambda t: quality.repeated_keys(_lines_as_stored(t), ["order_id", "product_id"]),
    "dup_products": lambda t: quality.repeated_keys(t.products, ["product_id", "product_name", "category"]),
    "dup_products_of_two_lists": lambda t: quality.repeated_keys(
        t.products.unionByName(t.products.filter("product_id % 4 = 0")), ["product_id", "product_name", "category"]
    ),
    "feedback_cardinality": lambda t: quality.feedback_cardinality(t.feedback),
    "range_check_distance": lambda t: quality.range_checks(
        t.delivery.select("order_id", "distance_km"), "distance_km", 0, 5
    ),
    "range_check_delivery_minutes": lambda t: quality.range_checks(
        t.delivery.select("order_id", "delivery_time_minutes"), "delivery_time_minutes", low=-5
    ),
    "range_check_rating": lambda t: quality.range_checks(t.feedback.select("feedback_id", "rating"), "rating", 0, 5),
    "range_check_rating_narrow": lambda t: quality.range_checks(t.feedback.select("feedback_id", "rating"), "rating", 2, 4),
    "null_profile": lambda t: quality.null_profile(t.delivery_raw),
    "row_duplicates": lambda t: quality.row_duplicates(_lines_as_stored(t)),
    "row_duplicates_subset": lambda t: quality.row_duplicates(_lines_as_stored(t), ["order_id", "line_number"]),
    "describe_numeric": lambda t: quality.describe_numeric(
        t.orders, ["order_total", "delivery_gap_in_minutes", "gap_between_promised_actual_time"]
    ),
    "describe_delivery": lambda t: quality.describe_numeric(t.delivery, ["distance_km", "delivery_time_minutes"]),
    "null_violations": lambda t: quality.null_violations(_required(t)),
    "key_violations": lambda t: quality.key_violations({
        "orders": (t.orders, ["order_id"]), "customers": (t.customers, ["customer_id"]), "feedback": (t.feedback, ["feedback_id"]),
        "products": (t.products, ["product_id"]), "order_items": (t.items, ["order_id", "product_id"]), "delivery": (t.delivery, ["order_id"]),
    }),
    "dup_line_ship_dates": lambda t: quality.duplicate_rank(
        t.raw("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")),
        "l_orderkey", "l_shipdate", ["l_linenumber", "l_partkey", "l_suppkey"],
    ),
    "later_event_times": lambda t: quality.later_dates(
        t.raw("events"), ["user_id", "event_type"], "ts", "time_rank", ["event_id", "user_id", "event_type"]
    ),
    "orphan_lines": lambda t: quality.orphans(
        t.raw("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", t.raw("events"), "event_id"
    ),
    "distinct_values": lambda t: quality.distinct_values(t.orders, "payment_method"),
    # cohorts
    "cohort_retention": lambda t: cohort.cohort_retention(t.orders),
    "cohort_retention_by_loads": lambda t: cohort.retention_of(state.active_months(_state_of_loads(t))),
    "cohort_avg_retention": lambda t: cohort.cohort_avg_retention(t.orders),
    "cohort_avg_retention_two_digits": lambda t: cohort.cohort_avg_retention(t.orders, 2),
    "cohort_avg_retention_excl_100": lambda t: cohort.cohort_avg_retention_excl_100(t.orders),
    "cohort_month_change": lambda t: cohort.cohort_month_change(t.orders),
    # customer value
    "rfm_fixed_bins": lambda t: customer.rfm_fixed_bins(t.orders, t.customers),
    "rfm_fixed_bins_by_loads": lambda t: customer.rfm_bins_of(_state_of_loads(t), t.customers),
    "rfm_lapsed_vs_active": lambda t: customer.rfm_lapsed_vs_active(customer.rfm_fixed_bins(t.orders, t.customers)),
    "rfm_ntile_segments": lambda t: customer.rfm_ntile_segments(t.orders, t.customers),
    "customer_lifetime_value": lambda t: customer.customer_lifetime_value(t.orders, t.customers, t.feedback),
    "customer_lifetime_value_own_feedback": lambda t: customer.customer_lifetime_value(
        t.orders, t.customers, t.feedback, dedupe=True
    ),
    "customer_category_basket": lambda t: customer.customer_category_basket(
        t.orders, t.customers, t.items, t.products
    ),
    "repeat_customer_pct_by_loads": lambda t: state.repeat_customer_pct(_state_of_loads(t)),
    "repeat_customer_pct": lambda t: customer.repeat_customer_pct(t.orders),
    "customer_negative_review_pct": lambda t: customer.customer_negative_review_pct(t.orders, t.feedback),
    "avg_negative_review_pct": lambda t: customer.avg_negative_review_pct(t.orders, t.feedback),
    "repeat_product_customers": lambda t: customer.repeat_product_customers(
        t.orders, t.customers, t.items, t.products
    ),
    # purchase sequences
    "next_product_symmetry": lambda t: sequence.next_product_symmetry(t.timeline, t.items, t.customers, t.products),
    "next_category_propensity": _propensity,
    "next_category_top": lambda t: sequence.next_category_top(_propensity(t)),
    "next_category_demand": lambda t: sequence.next_category_demand(t.timeline, t.items, t.products),
    "next_product_value": lambda t: sequence.next_product_value(t.timeline, t.items, t.products, t.customers),
    "next_category_value": lambda t: sequence.next_category_value(t.timeline, t.items, t.products, t.customers),
    "triple_repeat_product": lambda t: sequence.triple_repeat_product(t.timeline, t.items, t.customers, t.products),
    "same_product_gap": lambda t: sequence.same_product_gap(t.orders, t.customers, t.items, t.products),
    "product_reorder_gap": lambda t: sequence.product_reorder_gap(t.items, t.products, t.orders),
    # delivery
    "delivery_timing_feedback": lambda t: delivery.delivery_timing_feedback(t.feedback, t.orders),
    "hourly_delivery": lambda t: delivery.hourly_delivery(t.orders),
    "late_penalty": lambda t: delivery.late_penalty(t.timeline),
    "churn_after_delivery": lambda t: delivery.churn_after_delivery(t.timeline),
    "gap_flag_revenue": lambda t: delivery.gap_flag_revenue(t.orders),
    "late_rate_buckets": lambda t: delivery.late_rate_buckets(t.orders),
    "revenue_leakage": lambda t: delivery.revenue_leakage(t.timeline),
    "delay_vs_next_value": lambda t: delivery.delay_vs_next_value(t.timeline),
    "recovered_delivery_pct": lambda t: delivery.recovered_delivery_pct(t.timeline),
    "area_delivery": lambda t: delivery.area_delivery(t.orders, t.customers, t.feedback),
    "hourly_delivery_feedback": lambda t: delivery.hourly_delivery_feedback(t.orders, t.customers, t.feedback),
    "delivery_by_distance_year": lambda t: delivery.delivery_by_distance_year(t.delivery),
    "delivery_monthly_time": lambda t: delivery.delivery_monthly_time(t.delivery),
    "segment_bad_delivery": lambda t: delivery.segment_bad_delivery(t.customers, t.feedback),
    "delay_reason_share": lambda t: delivery.delay_reason_share(t.delivery),
    "traffic_delay_monthly": lambda t: delivery.traffic_delay_monthly(t.delivery),
    "traffic_delay_weekly": lambda t: delivery.traffic_delay_weekly(t.delivery),
    "reason_avg_time": lambda t: delivery.reason_avg_time(t.delivery),
    "partner_delivery_count": lambda t: delivery.partner_delivery_count(t.delivery),
    "distance_share": lambda t: delivery.distance_share(t.delivery),
    "gap_flag_count": lambda t: delivery.gap_flag_count(t.orders),
    # feedback
    "monthly_negative_rank": lambda t: feedback.monthly_negative_rank(t.feedback),
    "negative_rank_frequency": lambda t: feedback.negative_rank_frequency(feedback.monthly_negative_rank(t.feedback)),
    "monthly_delivery_review": lambda t: feedback.monthly_delivery_review(t.orders, t.feedback),
    "monthly_feedback_ratio": lambda t: feedback.monthly_feedback_ratio(t.orders, t.feedback),
    "churn_after_bad_review": lambda t: feedback.churn_after_bad_review(t.timeline, t.feedback),
    "bad_review_reasons": lambda t: feedback.bad_review_reasons(t.orders, t.feedback),
    "worst_category_per_month": lambda t: feedback.worst_category_per_month(t.orders, t.customers, t.feedback),
    "area_negative_feedback": lambda t: feedback.area_negative_feedback(t.orders, t.customers, t.feedback),
    "product_quality_sentiment": lambda t: feedback.product_quality_sentiment(
        t.items, t.products, t.feedback, t.orders
    ),
    "sentiment_share": lambda t: feedback.sentiment_share(t.feedback),
    "category_avg_rating": lambda t: feedback.category_avg_rating(t.feedback),
    "rating_share": lambda t: feedback.rating_share(t.feedback),
    "year_sentiment_count": lambda t: feedback.year_sentiment_count(t.feedback),
    # growth
    "qoq_growth": lambda t: growth.qoq_growth(t.orders, t.items, t.products),
    "mom_growth_calendar_month": lambda t: growth.mom_growth_calendar_month(t.orders),
    "mom_revenue": lambda t: growth.mom_revenue(t.orders),
    "mau_growth": lambda t: growth.mau_growth(t.orders, t.feedback),
    "quarterly_performance": lambda t: growth.quarterly_performance(t.orders, t.feedback),
    "quarterly_performance_own_feedback": lambda t: growth.quarterly_performance(t.orders, t.feedback, dedupe=True),
    "hourly_orders_rank": lambda t: growth.hourly_orders_rank(t.orders),
    "month_week_sales": lambda t: growth.month_week_sales(t.orders),
    "price_vs_revenue_monthly": lambda t: growth.price_vs_revenue_monthly(t.orders, t.items),
    "monthly_avg_sales": lambda t: growth.monthly_avg_sales(t.orders),
    "yearly_revenue": lambda t: growth.yearly_revenue(t.orders),
    "registrations_by_year": lambda t: growth.registrations_by_year(t.customers),
    # products
    "monthly_category_contribution": lambda t: product.monthly_category_contribution(t.orders, t.items, t.products),
    "margin_tier_summary": lambda t: product.margin_tier_summary(t.orders, t.items, t.products),
    "margin_product": lambda t: product.margin_product(t.orders, t.items, t.products),
    "margin_category_rollup": lambda t: product.margin_category_rollup(
        product.margin_product(t.orders, t.items, t.products)
    ),
    "area_product_rank": lambda t: product.area_product_rank(t.orders, t.items, t.products, t.customers),
    "product_contribution": lambda t: product.product_contribution(t.orders, t.items, t.products),
    "monthly_top5_products": lambda t: product.monthly_top_products(t.orders, t.items, t.products),
    "monthly_top1_product_tally": lambda t: product.monthly_top_tally(
        t.orders, t.items, t.products, "product_name", 1
    ),
    "monthly_top3_category_tally": lambda t: product.monthly_top3_category_tally(t.orders, t.items, t.products),
    "best_selling_product": lambda t: product.best_selling_product(t.items, t.products),
    "order_value_audit": lambda t: product.order_value_audit(t.orders, t.items, t.products),
    "order_value_ratio_extremes": lambda t: product.order_value_ratio_extremes(t.orders, t.items, t.products),
    "valid_orders_filter": lambda t: product.valid_orders_filter(t.orders, t.items, t.products),
    "iqr_inliers": lambda t: product.iqr_inliers(_event_values(t), "value"),
    "iqr_inliers_orders": lambda t: product.iqr_inliers(
        t.orders.select("order_id", F.col("order_total").cast("double").alias("order_total")), "order_total"
    ),
    "category_avg_mrp": lambda t: product.category_avg_mrp(t.products),
    "category_stock_value": lambda t: product.category_stock_value(t.products),
    "item_count_by_product": lambda t: product.item_count_by_product(t.items),
}


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    return JOBS[name](RetailTables(spark, directory))


#: Jobs that read files as delivered, or other tables than the six of ``ingest``.
NEED_RAW = frozenset("""load_csv load_rejects parse_dates order_enrich delivery_gap_flag calendar_parts normalise_text
normalise_delay_reason fill_missing_reason distance_flag_closed_bands distance_category_cumulative product_profit
pk_violations dup_order_items null_profile row_duplicates row_duplicates_subset iqr_inliers dup_line_ship_dates
later_event_times orphan_lines""".split())

#: Jobs that write files, or look up which partitions to read, while they are defined; a view of them would be frozen.
EAGER = frozenset("""load_csv write_csv load_append load_repeated load_rejects cohort_retention_by_loads rfm_fixed_bins_by_loads
repeat_customer_pct_by_loads new_load_repeats new_load_unknown""".split())


def register_views(tables: RetailTables, names: list[str], prefix: str = "vw_") -> None:
    """Offer analyses to SQL users as temporary views; they are computed when queried.

    Jobs that are computed when they are defined are refused: store their result instead.
    """
    if frozen := sorted(EAGER.intersection(names)):
        raise ValueError(f"no views of {frozen}: they are computed when defined")
    for name in names:
        JOBS[name](tables).createOrReplaceTempView(f"{prefix}{name}")
