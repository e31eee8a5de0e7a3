"""NULL times, customers and values, infinities, large sums, hot keys after joins."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aislelens.functions import labels as L
from aislelens.functions import numeric, timeline
from aislelens.operators import cohort, customer, product, quality, sequence
from aislelens.plans import catalog
from aislelens.sources.retail import RetailTables

START = dt.datetime(2024, 1, 1)
ORDERS = "order_id bigint, customer_id bigint, order_date timestamp_ntz, order_total decimal(18,2)"


def day(n):
    return START + dt.timedelta(days=n)


@pytest.mark.parametrize("min_rows", [0, 10**6])
@pytest.mark.parametrize("dense", [False, True])
def test_lookups_with_null_times_do_not_depend_on_the_limit(spark, monkeypatch, min_rows, dense):
    monkeypatch.setattr(timeline, "MIN_ROWS", min_rows)
    rnd = random.Random(3)
    rows = [(rnd.randrange(4), rnd.choice([None, day(rnd.randrange(5))]), rnd.choice([None, rnd.randrange(9)]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, x int, id int").repartition(5)
    sliced = timeline.slice_hot_keys(df, ["k"], "t")
    got = {r["id"]: r["n"] for r in timeline.with_next(sliced, ["k"], ["t", "x", "id"], {"n": "id"}).collect()}
    order = ["t"] if dense else ["t", "x", "id"]
    places = {r["id"]: r["p"] for r in timeline.with_position(sliced, ["k"], order, "p", dense).collect()}
    for k in range(4):
        last = lambda r: (r[1] is None, r[1] or START, r[2] is None, r[2] or 0, r[3])
        own = sorted((r for r in rows if r[0] == k), key=last)
        times = sorted({(r[1] is None, r[1] or START) for r in own})
        for at, r in enumerate(own):
            assert got[r[3]] == (own[at + 1][3] if at + 1 < len(own) else None)
            assert places[r[3]] == (times.index((r[1] is None, r[1] or START)) + 1 if dense else at + 1)


def test_slices_of_a_hot_key_are_dealt_after_the_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, 2, day(i), "x", i) for i in range(9)], "customer_id int, feedback_id int, feedback_date timestamp_ntz, feedback_text string, order_id int")
        orders = rows.withColumnRenamed("feedback_date", "order_date")
        names = spark.createDataFrame([(2, "p", "c")], "product_id int, product_name string, category string")
        items = rows.select("order_id", F.col("feedback_id").alias("product_id"))
        for df in (
            quality.duplicate_rank(rows, "customer_id", "feedback_date", ["feedback_id"]), quality.dup_feedback_dates(rows),
            quality.dup_customer_orders(orders, rows), sequence.same_product_gap(orders, rows.select("customer_id").distinct(), items, names),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
            windows = [i for i, line in enumerate(plan) if re.search(r"Window \[.*\], \[[^\]]*_slice[^\]]*\], \[", line)]
            assert windows
            for i in windows:
                below = [line for line in plan[i + 1 : i + 4] if "Exchange" in line]
                assert below and "_slice" in below[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_the_same_product_with_their_multiplicity(spark):
    rnd = random.Random(5)
    bought = [(i, rnd.randrange(3), day(rnd.randrange(6)), rnd.randrange(2)) for i in range(60)]
    orders = spark.createDataFrame([(i, c, d) for i, c, d, _ in bought], "order_id int, customer_id int, order_date timestamp_ntz")
    items = spark.createDataFrame([(i, p) for i, _, _, p in bought], "order_id int, product_id int")
    products = spark.createDataFrame([(0, "a", "x"), (1, "b", "x")], "product_id int, product_name string, category string")
    rows = sequence.same_product_gap(orders, orders.select("customer_id").distinct(), items, products).collect()
    times = {}
    for r in rows:
        own = times.setdefault((r.customer_id, r.product_id), {})
        own[r.first_buying_date], own[r.next_buying_date] = r.purchases, r.next_purchases
    ours = {(c, p): sum(n * m for a, n in t.items() for b, m in t.items() if a < b) for (c, p), t in times.items()}
    wanted = {}
    for _, c, a, p in bought:
        for _, d, b, q in bought:
            if (c, p) == (d, q) and a < b:
                wanted[(c, p)] = wanted.get((c, p), 0) + 1
    assert ours == wanted


def test_large_totals_keep_their_cents(spark):
    df = spark.createDataFrame([(Decimal("1000000000000000.37"),), (Decimal("0.01"),)], "v decimal(18,2)")
    assert df.agg(numeric.total("v")).first()[0] == Decimal("1000000000000000.38")


def test_orders_without_customer_are_no_customer(spark):
    rows = [(1, 7, day(0), Decimal(5)), (2, None, day(0), Decimal(5)), (3, None, day(40), Decimal(5))]
    orders = spark.createDataFrame(rows, ORDERS)
    assert customer.repeat_customer_pct(orders).first()[0] == 0
    assert [r.customer_cnt for r in cohort.cohort_retention(orders).collect()] == [1]
    bins = customer.rfm_fixed_bins(orders, spark.createDataFrame([(7,)], "customer_id bigint"))
    assert [r.cust_size_pct for r in bins.collect()] == [100.0]


def test_products_without_a_value_rank_last(spark):
    rows = [(i, 1, day(i), v) for i, v in enumerate([None, None, Decimal(5), Decimal(7), Decimal(50), Decimal(60)])]
    items = spark.createDataFrame([(i, i // 2) for i in range(6)], "order_id bigint, product_id bigint")
    products = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "product_id bigint, product_name string")
    customers = spark.createDataFrame([(1, "A")], "customer_id bigint, area string")
    got = product.area_product_rank(spark.createDataFrame(rows, ORDERS), items, products, customers).collect()
    assert {r.product_id: r.aov_rnk for r in got} == {2: 1, 1: 2, 0: 3}


def test_jobs_that_write_files_are_no_views(spark):
    with pytest.raises(ValueError, match="load_append"):
        catalog.register_views(None, ["load_append"])
    assert catalog.EAGER < set(catalog.JOBS) and catalog.NEED_RAW < set(catalog.JOBS)
    catalog.register_views(RetailTables(spark, "/root/testdata/sf0.001"), ["rfm_ntile_segments", "describe_numeric"])
    assert spark.sql("select count(*) from vw_describe_numeric").first()[0] == 3


def test_null_and_key_violations(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 3)], "a int, b int")
    assert [tuple(r) for r in quality.null_violations({"t": (df, ["a", "b"])}).collect()] == [("t", "a", 1), ("t", "b", 1)]
    assert [tuple(r) for r in quality.key_violations({"t": (df, ["a"])}).collect()] == [("t", 2)]


@pytest.mark.parametrize("bands,other,wanted", [
    (L.RECENCY_BANDS, 5, {0: 1, 20: 1, 21: 2, 35: 2, 36: 3, 50: 3, 51: 4, 80: 4, 81: 5}),
    (L.FREQUENCY_BANDS, 5, {1: 5, 2: 4, 3: 3, 4: 2, 6: 2, 7: 1, 9: 1, 10: 5}),
    (L.MONETARY_BANDS, 5, {800: 5, 801: 4, 1500: 4, 1501: 3, 3000: 3, 3001: 2, 5000: 2, 5001: 1}),
    (L.RECENCY_QUINTILE_BANDS, 1, {0: 5, 7: 5, 8: 4, 30: 4, 31: 3, 90: 3, 91: 2, 180: 2, 181: 1}),
    (L.DELIVERY_GAP_BANDS, "unknown timing", {9: "on time", 10: "slightly late", 19: "slightly late", 20: "very late", 39: "very late", 40: "unknown timing", 41: "concerningly late"}),
    (L.DAY_PART_BANDS, "none", {0: "night to early morning", 6: "night to early morning", 7: "morning to day", 12: "morning to day", 13: "noon to evening", 18: "noon to evening", 19: "night time"}),
    (L.LATE_RATE_BANDS, "above", {24: "25% late deliveries", 25: "50% late deliveries", 50: "50% late deliveries", 51: "75% late deliveries", 75: "75% late deliveries", 76: "above"}),
    (L.DELIVERY_TIMING_BANDS, "none", {-31: "none", -26: "customer might churn if delivery becomes this late", -21: "concerningly late delivery", -16: "very late delivery", -11: "late delivery", -6: "moderate late delivery", -1: "slightly late delivery", 0: "slightly fast delivery", 5: "slightly fast delivery", 6: "moderate late delivery"}),
])
def test_band_edges_as_given(spark, bands, other, wanted):
    """Literal figures, so that a wrong edge cannot pass by being shared with the SQL."""
    df = spark.createDataFrame([(v,) for v in wanted], "v int")
    assert {r.v: r.label for r in df.withColumn("label", L.band("v", bands, other)).collect()} == wanted
