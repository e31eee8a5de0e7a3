"""Tables laid out for lookups along a key's timeline.

Rows are bucketed by key and slice and sorted by time inside a bucket. A window by key and
slice then needs no shuffle, however often the table is read, and hot keys are found and cut once,
when the table is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislelens.functions.timeline import HOT, SLICE, slice_equally


def store_timeline(df: DataFrame, table: str, path: str, *, key: list[str], time: str, ties: list[str], buckets: int, rows: int | None = None) -> None:
    """Write ``df`` to ``path`` as the external bucketed table ``table``, replacing it.

    Slices are cut by ``time`` alone, so that any order that begins with the time respects
    them; ``ties`` only sort rows inside a bucket. ``rows`` is the wanted size of a slice.
    """
    sliced = slice_equally(df, key, [time], rows)
    order = [*key, SLICE, time, *ties]
    dealt = sliced.repartition(buckets, *key, SLICE).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *key, SLICE).sortBy(*order).saveAsTable(table)


def declare_timeline(spark: SparkSession, table: str, path: str, *, key: list[str], buckets: int) -> None:
    """Make a stored timeline known to the catalogue of a session that does not have it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = ", ".join(f"`{c}`" for c in [*key, SLICE])
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")


def slice_sizes(timeline: DataFrame, key: list[str]) -> DataFrame:
    """Rows of every slice of the hot keys: what one task gets."""
    return timeline.filter(HOT).groupBy(*key, SLICE).agg(F.count(F.lit(1)).alias("rows"))
