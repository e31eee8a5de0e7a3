"""The six retail tables, derived from a star-schema dataset directory.

The directory has no delivery times, feedback or order minutes, so those are fixed
arithmetic on the keys; every row of the input tables takes part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aislelens.operators import cleaning

# Margin per product type, feedback category per event type.
MARGIN_BY_TYPE = {"ECONOMY": 15, "STANDARD": 20, "SMALL": 25, "MEDIUM": 30, "LARGE": 35}
MARGIN_OTHER = 40
FEEDBACK_BY_EVENT = {"purchase": "product quality", "error": "delivery", "click": "app experience"}
FEEDBACK_OTHER = "customer service"


def _choose(column: str, mapping: dict, other) -> Column:
    out = None
    for key, value in mapping.items():
        test = F.col(column) == key
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return out.otherwise(F.lit(other))


def _money(value) -> Column:
    return F.round(value + 1e-9, 2).cast("decimal(18,2)")


class RetailTables:
    """Lazily defined tables; nothing is read until a job runs."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # ---- as they would arrive -------------------------------------------------------

    @cached_property
    def orders_raw(self) -> DataFrame:
        key = F.col("o_orderkey")
        minute = (key * 37 % 1440).cast("int")
        promise = (F.lit(30) + key % 11).cast("int")
        late = (key * 13 % 56 - 25).cast("int")

        def at(minutes):
            return F.timestamp_add("MINUTE", minutes, F.col("o_orderdate"))

        return self.raw("orders").select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            at(minute).alias("order_date"),
            at(minute + promise).alias("promised_delivery_time"),
            at(minute + promise + late).alias("actual_delivery_time"),
            _money(F.col("o_totalprice") / 1000).alias("order_total"),
            F.col("o_orderpriority").alias("payment_method"),
            (key % 40).cast("int").alias("delivery_partner_id"),
        )

    @cached_property
    def products_raw(self) -> DataFrame:
        margin = _choose("p_type", MARGIN_BY_TYPE, MARGIN_OTHER)
        mrp = F.col("p_retailprice").cast("decimal(18,2)")
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.round(mrp * (F.lit(100) - margin) * F.lit("0.01").cast("decimal(3,2)"), 2)
            .cast("decimal(18,2)").alias("price"),
            mrp.alias("mrp"),
            margin.alias("margin_percentage"),
            (F.lit(10) + F.col("p_size") % 21).cast("int").alias("min_stock_level"),
        )

    @cached_property
    def delivery_raw(self) -> DataFrame:
        late = (F.col("order_id") * 13 % 56 - 25).cast("int")
        return self.orders_raw.select(
            "order_id",
            "delivery_partner_id",
            F.col("promised_delivery_time").alias("promised_time"),
            F.col("actual_delivery_time").alias("actual_time"),
            late.cast("double").alias("delivery_time_minutes"),
            ((F.lit(5) + F.col("order_id") % 48) / 10).cast("decimal(4,1)").cast("double").alias("distance_km"),
            F.when(late <= 0, "on time").when(late <= 15, "slightly delayed")
            .otherwise("significantly delayed").alias("delivery_status"),
            F.when(late > 0, "Traffic").alias("reasons_if_delayed"),
        )

    # ---- cleaned --------------------------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        return cleaning.clean_orders(self.orders_raw)

    @property
    def timeline(self) -> DataFrame:
        """The orders for lookups along a customer's timeline."""
        return self.orders

    @cached_property
    def products(self) -> DataFrame:
        return cleaning.clean_products(self.products_raw)

    @cached_property
    def delivery(self) -> DataFrame:
        return cleaning.clean_delivery(self.delivery_raw)

    @cached_property
    def items(self) -> DataFrame:
        """One line per order: the first in line order. A minimum is combined on the map
        side, so an order with very many lines sends one row per task."""
        line_order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
        first = self.raw("lineitem").groupBy("l_orderkey").agg(F.min(F.struct(*line_order)).alias("line"))
        return first.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("line.l_partkey").alias("product_id"),
            F.col("line.l_quantity").cast("int").alias("quantity"),
            _money(F.col("line.l_extendedprice") / F.col("line.l_quantity") / 100).alias("unit_price"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
        return cleaning.clean_customers(
            self.raw("customer")
            .join(nation, "c_nationkey")
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                "area",
                F.lower("c_mktsegment").alias("customer_segment"),
                F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 13 % 2000).cast("int"))
                .alias("registration_date"),
            )
        )

    @cached_property
    def feedback(self) -> DataFrame:
        events = self.raw("events").select(
            F.col("event_id").alias("o_orderkey"), "ts", "event_type", "value", "props"
        )
        rating = (F.lit(1) + F.floor("value") % 5).cast("int")
        joined = events.join(self.raw("orders").select("o_orderkey", "o_custkey"), "o_orderkey").select(
            F.col("o_orderkey").alias("feedback_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            rating.alias("rating"),
            F.col("props").alias("feedback_text"),
            _choose("event_type", FEEDBACK_BY_EVENT, FEEDBACK_OTHER).alias("feedback_category"),
            F.when(rating <= 2, "negative").when(rating == 3, "neutral").otherwise("positive").alias("sentiment"),
            F.col("ts").alias("feedback_date"),
        )
        return cleaning.clean_feedback(joined)
