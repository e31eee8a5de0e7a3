"""What is kept of every customer between loads, and how the states of several loads merge.

A state holds one row per customer: the set of months with orders and the sums that the
analyses of cohorts, recency, frequency and spend need. All of it merges in any order, so a load
that comes late, or again, changes the result exactly as its orders would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import numeric as N
from aislelens.sources import loads

COLUMNS = ["customer_id", "months", "last_day", "frequency", "monetary"]


def customer_state(orders: DataFrame) -> DataFrame:
    """One row per customer, one more for orders without a customer: months, last day, orders and their total."""
    return orders.groupBy("customer_id").agg(
        F.collect_set(cal.month_start("order_date")).alias("months"),
        cal.day_of(F.max("order_date")).alias("last_day"),
        F.count("order_id").alias("frequency"),
        F.sum("order_total").cast("decimal(38,2)").alias("monetary"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of any number of loads as one: sets are united, sums added."""
    return states.groupBy("customer_id").agg(
        F.array_distinct(F.flatten(F.collect_list("months"))).alias("months"),  # a set per load, each bounded by the calendar
        F.max("last_day").alias("last_day"), F.sum("frequency").alias("frequency"),
        F.sum("monetary").cast("decimal(38,2)").alias("monetary"),
    )


def add_load(orders: DataFrame, target: str, load_id: str) -> loads.LoadReport:
    """Keep the state of one load's orders; a load that runs again replaces its own."""
    return loads.load(customer_state(orders), target, load_id)


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The state after all loads so far: reads one row per customer and load, no orders."""
    return merged(loads.read_loads(spark, target).select(*COLUMNS))


def merged_of(parts: list[DataFrame]) -> DataFrame:
    return merged(reduce(DataFrame.unionByName, parts))


def active_months(state: DataFrame) -> DataFrame:
    return state.filter("customer_id is not null").select("customer_id", "months")


def repeat_customer_pct(state: DataFrame) -> DataFrame:
    """Share of customers with more than one order."""
    known = state.filter("customer_id is not null")
    return known.agg(N.whole_percent(F.count_if(F.col("frequency") > 1), F.count(F.lit(1))).alias("repeated_customer_pct"))
