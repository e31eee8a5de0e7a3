"""Monthly acquisition cohorts and how many of their customers come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislelens.functions import calendar as cal
from aislelens.functions import labels as L
from aislelens.functions import numeric as N


def active_months(orders: DataFrame) -> DataFrame:
    """The set of months each customer ordered in: bounded by the calendar, however many orders there are."""
    return orders.filter("customer_id is not null").groupBy("customer_id").agg(
        F.collect_set(cal.month_start("order_date")).alias("months")
    )


def _active_customers(months: DataFrame) -> DataFrame:
    """Distinct active customers per (birth month, months since), from every customer's set of months.

    One shuffle by customer carried the sets, merged on the map side; after it a plain count
    replaces the distinct count.
    """
    active = months.select(
        F.array_min("months").alias("birth_month"), F.explode("months").alias("month")
    )
    offset = cal.months_between_starts(F.col("month"), F.col("birth_month"))
    return active.groupBy("birth_month", offset.alias("month_number")).agg(
        F.count(F.lit(1)).alias("customer_cnt")
    )


def retention_of(months: DataFrame) -> DataFrame:
    """Retention from every customer's set of months, as ``active_months`` gives or a merged state holds it."""
    by_month = Window.partitionBy("birth_month").orderBy("month_number")
    return (
        _active_customers(months)
        .withColumn("first_month_customer_cnt_locked", F.first("customer_cnt").over(by_month))
        .withColumn("retention_rate", N.percent("customer_cnt", "first_month_customer_cnt_locked"))
    )


def cohort_retention(orders: DataFrame) -> DataFrame:
    return retention_of(active_months(orders))


def cohort_avg_retention(orders: DataFrame, digits: int = 3) -> DataFrame:
    return cohort_retention(orders).groupBy("month_number").agg(
        N.half_up(F.avg("retention_rate"), digits).alias("avg_retention_rate")
    )


def cohort_avg_retention_excl_100(orders: DataFrame) -> DataFrame:
    """One average over all cohort cells that are not at 100 percent."""
    rates = cohort_retention(orders).filter("retention_rate <> 100")
    return rates.agg(N.half_up(F.avg("retention_rate"), 6).alias("avg_retention_rate"))


def cohort_month_change(orders: DataFrame) -> DataFrame:
    by_month = Window.partitionBy("cohort_month").orderBy("month_number")
    cells = _active_customers(active_months(orders)).select(
        F.col("birth_month").alias("cohort_month"), "month_number", F.col("customer_cnt").alias("active_customers")
    )
    previous = F.col("prev_active_customer_count")
    return cells.withColumn("prev_active_customer_count", F.lag("active_customers").over(by_month)).withColumns({
        "monthly_change_pct": F.coalesce(N.growth("active_customers", previous), F.lit(0.0)),
        "retention_improve_cycle": F.when(previous < F.col("active_customers"), L.RETENTION_UP),
    })
