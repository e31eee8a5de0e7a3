"""From delivered CSV files to cleaned, appended tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from aislelens.operators import cleaning
from aislelens.sources import files, layout, loads, schemas

# table -> (schema of the delivered file, cleaning, partition column of the target)
TABLES = {
    "orders": (schemas.ORDERS, cleaning.clean_orders, ["order_year", "order_month"]),
    "customers": (schemas.CUSTOMERS, cleaning.clean_customers, None),
    "feedback": (schemas.FEEDBACK, cleaning.clean_feedback, ["feedback_year", "feedback_month"]),
    "products": (schemas.PRODUCTS, cleaning.clean_products, None),
    "order_items": (schemas.ORDER_ITEMS, lambda df: df, None),
    "delivery": (schemas.DELIVERY, cleaning.clean_delivery, ["delivery_year", "delivery_month"]),
}

#: Columns without which a record cannot be used.
REQUIRED = {
    "orders": ["order_id", "order_date"], "customers": ["customer_id"], "feedback": ["feedback_id"], "products": ["product_id"],
    "order_items": ["order_id", "product_id"], "delivery": ["order_id"],
}


def read_cleaned(spark: SparkSession, table: str, path: str, **options: str) -> DataFrame:
    schema, clean, _ = TABLES[table]
    return clean(files.load_csv(spark, path, schema, **options))


def ingest(
    spark: SparkSession, delivered: dict[str, str], target: str, load_id: str | None = None, max_reject_share: float = 0.0, **options: str,
) -> dict[str, loads.LoadReport]:
    """Clean each delivered file set and append it to ``<target>/<table>``.

    Time-stamped tables are partitioned by year and month so that analyses of a period
    read only its files. Rows are rebalanced by those columns before writing: adaptive
    execution aims at files of the advisory size and splits a month that is too large.

    With a ``load_id`` the load can be repeated: it replaces what it added before. Records that
    cannot be read go to ``<target>/rejects/<table>`` then; if they are more than
    ``max_reject_share`` of a table's records, that table's load stops before anything is published.
    Without one, the first bad record ends the load.
    """
    reports, target = {}, target.rstrip("/")
    for table, path in delivered.items():
        schema, clean, parts = TABLES[table]
        if load_id is not None:
            reports[table] = loads.load_files(
                spark, path, schema, f"{target}/{table}", load_id, rejects=f"{target}/rejects/{table}", clean=clean, partition_by=parts or (),
                required=REQUIRED[table], max_reject_share=max_reject_share, **options,
            )
            continue
        cleaned = read_cleaned(spark, table, path, **options)
        if parts:
            cleaned = cleaned.hint("rebalance", *parts)
        files.load_append(cleaned, f"{target}/{table}", parts)
    return reports


def store_order_timeline(spark: SparkSession, folder: str, table: str, buckets: int, rows: int | None = None) -> None:
    """Lay the ingested orders out by customer and time, as ``<folder>/order_timeline`` and as a table of the catalogue.

    Give that table's name to ``StoredTables``, and the analyses along customers' timelines read it without a shuffle.
    It is a copy: store it again after a load.
    """
    orders = StoredTables(spark, folder).orders
    path = f"{folder.rstrip('/')}/order_timeline"
    layout.store_timeline(orders, table, path, key=["customer_id"], time="order_date", ties=["order_id"], buckets=buckets, rows=rows)


class StoredTables:
    """The ingested tables, under the names the analyses in ``catalog.JOBS`` expect."""

    def __init__(self, spark: SparkSession, folder: str, timeline: str | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.timeline_table = timeline

    @cached_property
    def timeline(self) -> DataFrame:
        """The orders for lookups along a customer's timeline, laid out for them if they were stored so."""
        return self.spark.table(self.timeline_table) if self.timeline_table else self.orders

    def _table(self, name: str) -> DataFrame:
        return loads.read_loads(self.spark, f"{self.folder}/{name}").drop(loads.LOAD)

    @cached_property
    def orders(self) -> DataFrame:
        return self._table("orders")

    @cached_property
    def customers(self) -> DataFrame:
        return self._table("customers")

    @cached_property
    def feedback(self) -> DataFrame:
        return self._table("feedback")

    @cached_property
    def products(self) -> DataFrame:
        return self._table("products")

    @cached_property
    def items(self) -> DataFrame:
        return self._table("order_items")

    @cached_property
    def delivery(self) -> DataFrame:
        return self._table("delivery")
