"""Cases the shared tables cannot show, on small hand-made frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aislelens.functions import labels as L
from aislelens.functions import numeric as N
from aislelens.operators import cleaning, cohort, customer, delivery, feedback, growth, product, quality, sequence

DAY = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def at(days, minutes=0):
    return DAY + dt.timedelta(days=days, minutes=minutes)


def orders_frame(spark, data):
    """(order, customer, date, total, promised minus actual, order to delivery)"""
    schema = """order_id bigint, customer_id bigint, order_date timestamp_ntz, order_total decimal(18,2),
                gap_between_promised_actual_time double, delivery_gap_in_minutes double"""
    df = spark.createDataFrame([(o, c, d, Decimal(t), g, m) for o, c, d, t, g, m in data], schema)
    return df.withColumns({"order_hour": F.hour("order_date"), "order_month": F.month("order_date")})


def feedback_frame(spark, data):
    """(feedback, order, customer, rating, category, sentiment, date)"""
    return spark.createDataFrame(
        data,
        """feedback_id bigint, order_id bigint, customer_id bigint, rating int, feedback_category string,
           sentiment string, feedback_date timestamp_ntz""",
    )


def customers_frame(spark, *ids):
    return spark.createDataFrame(
        [(i, f"c{i}", f"area{i % 2}", "new", at(i)) for i in ids],
        "customer_id bigint, customer_name string, area string, customer_segment string, registration_date timestamp_ntz",
    )


# ---- numbers and labels ---------------------------------------------------------------

def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.675,), (-2.675,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(N.half_up("x")).collect()] == [2.68, -2.68, 0.13, None]


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(1, 0)], "a int, b int")
    assert df.select(N.ratio("a", "b"), N.percent("a", "b"), N.whole_percent("a", "b"), N.growth("a", "b")).first() == (
        None, None, None, None
    )


def test_whole_percent_cuts_the_fraction(spark):
    assert spark.range(1).select(N.whole_percent(F.lit(2), F.lit(3))).first()[0] == 66.0


@pytest.mark.parametrize("minutes,label", [
    (-3.0, "on time"), (9.99, "on time"), (10.0, "slightly late"), (19.99, "slightly late"), (20.0, "very late"),
    (39.99, "very late"), (40.0, "unknown timing"), (40.01, "concerningly late"), (None, "unknown timing"),
])
def test_delivery_gap_flag(spark, minutes, label):
    df = spark.createDataFrame([(minutes,)], "delivery_gap_in_minutes double")
    assert cleaning.delivery_gap_flag(df).first()["delivery_gap_flag"] == label


@pytest.mark.parametrize("km,flag,category", [
    (0.5, "below 1 km", "below 1 km"), (0.995, "unknown distance", "below 1 km"), (1.0, "between 1 km", "below 1 km"),
    (1.99, "between 1 km", "below 2 km"), (4.5, "between 4 km", "below 5 km"), (5.0, "between 4 km", "below 5 km"),
    (5.1, "unknown distance", "above 5 km"), (None, "unknown distance", "above 5 km"), (-1.0, "unknown distance", "below 1 km"),
])
def test_distance_labels(spark, km, flag, category):
    df = spark.createDataFrame([(km,)], "distance_km double")
    out = cleaning.distance_category_cumulative(cleaning.distance_flag_closed_bands(df)).first()
    assert (out["delivery_distance_flag"], out["delivery_distance_category"]) == (flag, category)


@pytest.mark.parametrize("column,bands,value,score", [
    ("m", L.MONETARY_BANDS, 5000.0, 2), ("m", L.MONETARY_BANDS, 5000.01, 1), ("m", L.MONETARY_BANDS, 3000.5, 5),
    ("m", L.MONETARY_BANDS, 3000.0, 3), ("m", L.MONETARY_BANDS, 1500.5, 5), ("m", L.MONETARY_BANDS, 800.0, 5),
    ("f", L.FREQUENCY_BANDS, 10.0, 5), ("f", L.FREQUENCY_BANDS, 9.0, 1), ("f", L.FREQUENCY_BANDS, 2.0, 4),
    ("r", L.RECENCY_BANDS, 0.0, 1), ("r", L.RECENCY_BANDS, 80.0, 4), ("r", L.RECENCY_BANDS, 81.0, 5),
])
def test_scores_follow_the_band_edges(spark, column, bands, value, score):
    df = spark.createDataFrame([(value,)], f"{column} double")
    assert df.select(L.band(column, bands, L.SCORE_OTHER)).first()[0] == score


# ---- cleaning -------------------------------------------------------------------------

def test_calendar_parts_at_a_year_boundary(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 23, 59),)], "t timestamp_ntz")
    assert cleaning.calendar_parts(df, "t", "x").drop("t").first().asDict() == {
        "x_year": 2024, "x_month": 12, "x_week": 1, "x_day_name": "Mon",
        "x_weekly_period": "2024-12-30/2025-01-05", "x_day": 30, "x_hour": 23,
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_arithmetic_ignores_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # the hour that New York skips on this day
        df = spark.createDataFrame([(1,)], "i int").selectExpr(
            "timestamp_ntz'2024-03-10 01:50:00' order_date", "timestamp_ntz'2024-03-10 02:30:30.5' actual_delivery_time",
            "timestamp_ntz'2024-03-10 02:20:00' promised_delivery_time",
        )
        out = cleaning.order_enrich(df).first()
        assert out["delivery_gap_in_minutes"] == pytest.approx(40 + 30.5 / 60)
        assert out["gap_between_promised_actual_time"] == pytest.approx(-(10 + 30.5 / 60))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_product_cleaning(spark):
    df = spark.createDataFrame(
        [(1, "Fresh Onions", "Fruits & Veg", 947.95, 1263.93)],
        "product_id bigint, product_name string, category string, price double, mrp double",
    )
    assert cleaning.clean_products(df).first()[1:] == ("fresh onions", "fruits & veg", 947.95, 1263.93, 315.98)


def test_delay_reasons(spark):
    df = spark.createDataFrame([(1, "Traffic"), (2, None), (3, "rain")], "order_id int, reasons_if_delayed string")
    out = cleaning.fill_missing_reason(cleaning.normalise_text(df, [], {"reasons_if_delayed": L.REASON_SPELLINGS}))
    assert [r[1] for r in rows(out, "order_id")] == ["traffic", "not given", "rain"]


def test_schema_evolution(spark):
    df = spark.createDataFrame([(1, 919999999999, "x")], "a int, phone bigint, old string")
    out = cleaning.schema_evolution(df, {"a": "bigint"}, {"old": "new"}, ["phone", "not_there"])
    assert out.dtypes == [("a", "bigint"), ("new", "string")]


# ---- quality --------------------------------------------------------------------------

def test_orphans_and_foreign_keys(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "1", 0.0, 1.0), (2, 9, at(0), "1", 0.0, 1.0), (3, 9, at(0), "1", 0.0, 1.0)])
    known = customers_frame(spark, 1)
    given = feedback_frame(spark, [(1, 2, 9, 5, "delivery", "positive", at(0)), (2, None, 9, 5, "delivery", "positive", at(0))])
    assert [r["order_id"] for r in quality.orphan_orders(orders, known, given).collect()] == [3]
    checks = [("oc", orders, "customer_id", known), ("fo", given, "order_id", orders), ("fc", given, "customer_id", known)]
    assert rows(quality.fk_violations(checks), "constraint_name") == [
        ("fc", "customer_id", 2), ("fo", "order_id", 0), ("oc", "customer_id", 2)
    ]


def test_duplicates_and_keys(spark):
    df = spark.createDataFrame(
        [(1, at(0), 1), (1, at(2), 2), (1, at(2), 3), (2, at(0), 4), (None, at(0), 5)], "k bigint, t timestamp_ntz, id int"
    )
    assert rows(quality.duplicate_rank(df, "k", "t", ["id"]), "duplicate_rank") == [(1, 2), (1, 3)]
    assert sorted(rows(quality.pk_violations(df, ["k"])), key=str) == [(1, 3), (None, 1)]
    assert rows(quality.repeated_keys(df, ["k", "t"])) == [(1, at(2), 2)]
    assert rows(quality.later_dates(df, ["k"], "t", "rank", ["k", "id"]), "id") == [(1, 2, 2), (1, 3, 2)]


def test_duplicate_feedback_and_orders(spark):
    given = feedback_frame(spark, [
        (1, 1, 7, 5, "delivery", "positive", at(0)), (1, 1, 7, 5, "delivery", "positive", at(3)),
        (2, 2, 7, 5, "delivery", "positive", at(1)),
    ]).withColumn("feedback_text", F.lit("ok"))
    assert rows(quality.dup_feedback_dates(given)) == [(7, 1, at(3), "ok", 2)]
    assert rows(quality.feedback_cardinality(given)) == [(3, 1)]
    orders = orders_frame(spark, [(1, 7, at(0), "1", 0.0, 1.0), (1, 7, at(1), "1", 0.0, 1.0), (5, 8, at(0), "1", 0.0, 1.0), (5, 8, at(1), "1", 0.0, 1.0)])
    assert rows(quality.dup_customer_orders(orders, customers_frame(spark, 7))) == [(7, 1, 2)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 4.0), (3, 6.0)], "a int, b double")
    assert rows(quality.null_profile(df), "column_name") == [("a", 0, 0.0), ("b", 2, 50.0)]
    assert rows(quality.row_duplicates(df)) == [(1,)]
    assert rows(quality.row_duplicates(df, ["b"])) == [(1,)]
    assert rows(quality.range_checks(df, "b", 4.5, 5.5), "a") == [(2, 4.0), (3, 6.0)]
    out = {r["column_name"]: r for r in quality.describe_numeric(df, ["a", "b"]).collect()}
    assert (out["b"]["count"], out["b"]["mean"], out["b"]["q25"], out["b"]["max"]) == (2, 5.0, 4.5, 6.0)


# ---- cohorts and customers ------------------------------------------------------------

def test_cohorts(spark):
    orders = orders_frame(spark, [
        (1, 1, at(0), "1", 0.0, 1.0), (2, 1, at(1), "1", 0.0, 1.0), (3, 1, at(60), "1", 0.0, 1.0),
        (4, 2, at(0), "1", 0.0, 1.0), (5, 3, at(35), "1", 0.0, 1.0),
    ])
    january, february = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    assert rows(cohort.cohort_retention(orders), "birth_month", "month_number") == [
        (january, 0, 2, 2, 100.0), (january, 2, 1, 2, 50.0), (february, 0, 1, 1, 100.0),
    ]
    assert rows(cohort.cohort_avg_retention_excl_100(orders)) == [(50.0,)]
    change = rows(cohort.cohort_month_change(orders), "cohort_month", "month_number")
    assert change[1] == (january, 2, 1, 2, -50.0, None)
    assert change[0][4] == 0.0


def test_repeat_share_is_truncated(spark):
    orders = orders_frame(spark, [(i, c, at(0), "1", 0.0, 1.0) for i, c in enumerate([1, 1, 2, 2, 3])])
    assert rows(customer.repeat_customer_pct(orders)) == [(66.0,)]


def test_lifetime_value_fans_out_unless_asked_not_to(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "10", 1.0, 5.0), (2, 1, at(1), "30", 3.0, 15.0)])
    given = feedback_frame(spark, [
        (1, 1, 1, 1, "delivery", "negative", at(0)), (2, 1, 1, 5, "delivery", "positive", at(0)),
        (3, 2, 1, 5, "app experience", "positive", at(0)),
    ])
    known = customers_frame(spark, 1)
    assert rows(customer.customer_lifetime_value(orders, known, given)) == [
        (1, "c1", 6, 120.0, 20.0, 10.0, 2.0, 66.67, 33.33)
    ]
    assert rows(customer.customer_lifetime_value(orders, known, given, dedupe=True)) == [
        (1, "c1", 3, 50.0, 16.67, 8.33, 1.67, 66.67, 33.33)
    ]


# ---- sequences ------------------------------------------------------------------------

def lines(spark, data):
    """(order, customer, day, product, total) -> orders, items, products"""
    orders = orders_frame(spark, [(o, c, at(d), t, 0.0, 1.0) for o, c, d, _, t in data])
    items = spark.createDataFrame([(o, p, 1, 1.0) for o, _, _, p, _ in data], "order_id bigint, product_id bigint, quantity int, unit_price double")
    products = spark.createDataFrame(
        [(p, f"p{p}", f"cat{p % 2}") for p in sorted({r[3] for r in data})], "product_id bigint, product_name string, category string"
    )
    return orders, items, products


def test_sequences(spark):
    orders, items, products = lines(spark, [
        (1, 1, 0, 5, "10"), (2, 1, 2, 5, "20"), (3, 1, 9, 5, "30"), (4, 2, 0, 6, "40"), (5, 2, 0, 5, "50"),
    ])
    known = customers_frame(spark, 1, 2)
    assert rows(sequence.triple_repeat_product(orders, items, known, products)) == [(1, "p5", "p5", "p5")]
    assert rows(sequence.next_product_value(orders, items, products, known), "curr_prod_txn") == [
        ("p5", "p5", 2, 80.0), ("p6", "p5", 1, 90.0)
    ]
    gaps = sequence.same_product_gap(orders, known, items, products)
    assert [r[3:] for r in rows(gaps, "first_buying_date")] == [(at(0), at(2), 2, 0, 1, 1), (at(2), at(9), 7, 2, 1, 1)]
    # customers that are not known leave no trace
    assert rows(sequence.next_product_value(orders, items, products, customers_frame(spark, 2))) == [("p6", "p5", 1, 90.0)]


def test_every_pair_follows_from_the_gaps(spark):
    days = [0, 3, 3, 10, 11]
    orders, items, products = lines(spark, [(i, 1, d, 5, "1") for i, d in enumerate(days)])
    out = sequence.same_product_gap(orders, customers_frame(spark, 1), items, products).collect()
    first_days = {r["first_buying_date"]: r["days_since_first"] for r in out}
    last = max(out, key=lambda r: r["next_buying_date"])
    first_days[last["next_buying_date"]] = last["days_since_first"] + last["order_day_gap"]
    pairs = sorted(b - a for a in first_days.values() for b in first_days.values() if b > a)
    assert pairs == sorted(y - x for x in set(days) for y in set(days) if y > x)


def test_reorder_gap_counts_completed_days(spark):
    orders, items, products = lines(spark, [(1, 1, 0, 5, "1"), (2, 2, 1, 5, "1"), (3, 3, 4, 5, "1"), (4, 1, 0, 6, "1")])
    orders = orders.withColumn(
        "order_date", F.when(F.col("order_id") == 2, F.col("order_date") - F.expr("interval 1 hour")).otherwise(F.col("order_date"))
    )
    # 23 hours are no completed day, 3 days 1 hour are three
    assert rows(sequence.product_reorder_gap(items, products, orders), "product_id") == [(5, "p5", 1), (6, "p6", None)]


# ---- delivery and feedback ------------------------------------------------------------

def test_timing_bands_and_missing_orders(spark):
    orders = orders_frame(spark, [
        (1, 1, at(0), "1", -3.0, 1.0), (2, 1, at(1), "1", 7.0, 1.0), (3, 1, at(2), "1", 5.5, 1.0), (4, 1, at(2), "1", None, 1.0),
        (5, 1, at(2), "1", -31.0, 1.0),
    ])
    given = feedback_frame(spark, [(i, i, 1, 1, "delivery", "negative" if i == 1 else "positive", at(0)) for i in (1, 2, 3, 4, 5, 99)])
    out = {r[0]: tuple(r)[1:] for r in delivery.delivery_timing_feedback(given, orders).collect()}
    assert out["slightly late delivery"] == (-3.0, 1, 1, 1, 100.0, 16.67, 20.0)
    assert out["moderate late delivery"] == (7.0, 1, 0, 0, None, 0.0, 20.0)
    assert out["other timing"][1] == 3  # fractional, NULL and too late; the unmatched one has no order


def test_movements_between_orders(spark):
    orders = orders_frame(spark, [
        (1, 1, at(0), "10", -1.0, 1.0), (2, 1, at(4), "5", 2.0, 1.0), (3, 1, at(5), "5", 2.0, 1.0),
        (4, 2, at(0), "10", 3.0, 1.0), (5, 2, at(9), "5", 3.0, 1.0),
    ])
    moves = {r[0]: r[1:] for r in rows(delivery.delay_vs_next_value(orders))}
    assert moves["degraded order value but delivery timing improved"] == (1, 10.0, 20.0)
    assert moves["decreased order value but delivery timing stayed same"] == (1, 10.0, 20.0)
    assert moves["unknown timing and order value"] == (1, 5.0, 20.0)
    assert rows(delivery.recovered_delivery_pct(orders)) == [(20.0, 20.0)]
    assert rows(delivery.revenue_leakage(orders), "penalty_order_analysis") == [
        ("degraded order value", 2, 100.0), ("others", 1, 50.0)
    ]
    assert rows(delivery.churn_after_delivery(orders), "delivery_pattern") == [
        ("late delivery", 1, 0.0), ("on time delivery", 4, 50.0)
    ]
    assert rows(delivery.late_penalty(orders), "delivery_pattern") == [
        ("late delivery", 1, 4.0, 4.0), ("on time delivery", 2, 5.0, 5.0)
    ]


def test_same_steps_of_a_customer_count_once(spark):
    orders = orders_frame(spark, [(i, 1, at(i), t, 0.0, 1.0) for i, t in enumerate(["10", "5", "10", "5"])])
    assert rows(delivery.revenue_leakage(orders), "penalty_order_analysis") == [
        ("degraded order value", 1, 100.0), ("increased order value", 1, 100.0)
    ]


def test_hours_without_a_late_delivery_have_no_percentage(spark):
    orders = orders_frame(spark, [(1, 1, at(0, 60), "1", 5.0, 1.0), (2, 1, at(0, 120), "1", -5.0, 1.0)]).withColumns({
        "promised_delivery_time": F.col("order_date"),
        "actual_delivery_time": F.col("order_date") - F.make_dt_interval(mins=F.col("gap_between_promised_actual_time").cast("int")),
    })
    given = feedback_frame(spark, [(i, i, 1, 1, "delivery", "negative", at(0)) for i in (1, 2)])
    out = rows(delivery.hourly_delivery_feedback(orders, customers_frame(spark, 1), given), "order_hour")
    assert [(r[0], r[5], r[7]) for r in out] == [(1, None, 2), (2, 100.0, 1)]


def test_late_rate_edges(spark):
    data = [(100 * c + i, c, at(i), "1", -1.0 if i < late else 1.0, 1.0) for c, late in ((1, 0), (2, 1), (3, 2), (4, 3), (5, 4)) for i in range(4)]
    assert {r[0]: r[1] for r in rows(delivery.late_rate_buckets(orders_frame(spark, data)))} == {
        "25% late deliveries": 1, "50% late deliveries": 2, "75% late deliveries": 1, "all late deliveries": 1
    }


def test_churn_after_bad_review_looks_at_the_last_reviewed_order(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "1", 0.0, 1.0), (2, 1, at(40), "1", 0.0, 1.0), (3, 2, at(0), "1", 0.0, 1.0)])
    given = feedback_frame(spark, [(1, 1, 1, 1, "delivery", "negative", at(0)), (3, 3, 2, 1, "delivery", "negative", at(0))])
    assert rows(feedback.churn_after_bad_review(orders, given)) == [(dt.date(2024, 1, 1), 2, 2, 100.0)]


def test_shares_add_up_and_ranks_start_at_one(spark):
    given = feedback_frame(spark, [
        (i, i, i, 1 + i % 5, ["delivery", "app experience"][i % 2], ["negative", "positive", "neutral"][i % 3], at(i))
        for i in range(60)
    ])
    assert sum(r[2] for r in rows(feedback.sentiment_share(given))) == pytest.approx(100)
    assert sum(r[2] for r in rows(feedback.rating_share(given))) == pytest.approx(100)
    ranked = feedback.monthly_negative_rank(given)
    assert ranked.groupBy("feedback_month").agg(F.min("neg_rev_rank")).select("min(neg_rev_rank)").distinct().collect() == [(1,)]


# ---- growth and products --------------------------------------------------------------

def test_growth_from_the_first_month(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "10", 0.0, 1.0), (2, 1, at(40), "15", 0.0, 1.0), (3, 1, at(41), "5", 0.0, 1.0)])
    out = rows(growth.mom_revenue(orders), "order_month")
    assert out[0] == (dt.date(2024, 1, 1), 1, 10.0, 0, 0.0, 0.0, 0.0)
    assert out[1] == (dt.date(2024, 2, 1), 2, 20.0, 1, 10.0, 100.0, 100.0)


def test_orders_without_items_keep_their_own_tier(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "10", 0.0, 1.0), (2, 1, at(1), "30", 0.0, 1.0)])
    items = spark.createDataFrame([(1, 5)], "order_id bigint, product_id bigint")
    products = spark.createDataFrame(
        [(5, "p", "c", Decimal("2.00"), Decimal("4.00"), 15)],
        "product_id bigint, product_name string, category string, price decimal(18,2), mrp decimal(18,2), margin_percentage int",
    )
    assert rows(product.margin_tier_summary(orders, items, products), "margin_percentage") == [
        (None, 0, 0, 1, None, 30.0, None), (15, 1, 1, 1, 4.0, 10.0, 40.0)
    ]


def test_order_value_classes(spark):
    orders = orders_frame(spark, [(i, 1, at(0), t, 0.0, 1.0) for i, t in enumerate(["49", "50", "125", "126", "10"])])
    items = spark.createDataFrame(
        [(i, 5, 2, Decimal("50.00")) for i in range(4)] + [(4, 5, 0, Decimal("50.00"))],
        "order_id bigint, product_id bigint, quantity int, unit_price decimal(18,2)",
    )
    products = spark.createDataFrame([(5, "p", "c")], "product_id bigint, product_name string, category string")
    kinds = {r[0][:6]: r[1] for r in rows(product.order_value_audit(orders, items, products))}
    assert kinds == {"(< 0.4": 1, "(0.5 -": 2, "(>2) h": 2}  # nothing sold counts with the last
    assert rows(product.valid_orders_filter(orders, items, products)) == []  # both edges are excluded
    assert rows(product.order_value_ratio_extremes(orders, items, products)) == [(0.49, 1.26)]


def test_several_lines_per_order_repeat_its_total(spark):
    orders = orders_frame(spark, [(1, 1, at(0), "30", 0.0, 1.0)])
    items = spark.createDataFrame(
        [(1, 5, 1, Decimal("10.00")), (1, 6, 2, Decimal("5.00"))],
        "order_id bigint, product_id bigint, quantity int, unit_price decimal(18,2)",
    )
    products = spark.createDataFrame([(5,), (6,)], "product_id bigint")
    assert rows(product.order_value_ratio(orders, items, products)) == [(1, 3, 45.0, 60.0, 1.33)]


def test_inliers_of_a_column_with_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 1000, -1000]], "x double")
    out = rows(product.iqr_inliers(df, "x"), "x")
    assert [r[0] for r in out] == [1, 2, 3, 4, 5]
    assert out[0][1:] == (1.5, 4.5, -3.0, 9.0, 3.0)


def test_best_seller_tie_goes_to_the_lower_id(spark):
    items = spark.createDataFrame([(1, 9, 3), (2, 4, 3)], "order_id bigint, product_id bigint, quantity int")
    products = spark.createDataFrame([(9, "b"), (4, "a")], "product_id bigint, product_name string")
    assert rows(product.best_selling_product(items, products)) == [(4, "a", 1, 3)]


# ---- same answer however the data is spread -------------------------------------------

@pytest.mark.parametrize("name", [
    "cohort_avg_retention", "next_category_propensity", "late_penalty", "area_product_rank", "rfm_ntile_segments",
    "quarterly_performance",
])
def test_partition_count_does_not_matter(spark, name):
    from aislelens.plans import catalog

    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            results.append(sorted(map(str, catalog.run(name, spark, "/root/testdata/sf0.001").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1]
