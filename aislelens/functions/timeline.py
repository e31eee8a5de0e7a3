"""Next-row and position-in-group lookups that survive a hot key.

A window partitioned by customer (or product) hands every row of that customer to one
task. One customer may hold a large part of the data, so keys above a share of all rows
are cut into time slices first: the window then runs per (key, slice), and a second,
tiny window over one summary row per slice links each slice to the next.

Ordinary keys have a NULL slice, so they go through the very same single shuffle whole.
Rows without a time, and NULLs in any ordering column, come last; a hot key's rows without
a time have a slice of their own. The result does not depend on which keys are hot.

Tables that are stored for such lookups carry their slices: ``slice_equally`` cuts hot keys by
rank when they are written, and nothing is counted when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.sources.files import cut_lineage

SLICE = "_slice"
HOT = "_hot"

# A key is hot when it has more than MIN_ROWS rows and more than 1/MAX_HOT_KEYS of all
# rows. The second condition bounds the number of hot keys by MAX_HOT_KEYS whatever the
# data, which is what makes broadcasting them safe.
MAX_HOT_KEYS = 1_000_000
MIN_ROWS = 1_000_000


# Hot keys are cut by the hour, the very largest by the minute: about ten thousand rows
# per slice for a billion rows in ten years, and never more slices than the calendar has.
HUGE = 1_000_000_000

# The slice of rows without a time: after all others.
NO_TIME = "9999-12-31 23:59:59"


def _slice(ts: str, rows: Column) -> Column:
    t = F.col(ts)
    second, minute = F.date_part(F.lit("SECOND"), t), F.date_part(F.lit("MINUTE"), t)
    return F.coalesce(t - F.make_dt_interval(mins=F.when(rows > HUGE, 0).otherwise(minute), secs=second), F.lit(NO_TIME))


def _nulls_last(order: list[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def _sortable(order: list[str]) -> Column:
    """The same order as one value."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def mark_hot_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Add ``_hot`` (true or NULL) and the key's row count for hot keys.

    Marking a table before joining it lets the work that only concerns hot keys drop all
    other rows ahead of the join.
    """
    counted = df
    for k in key:
        counted = counted.filter(F.col(k).isNotNull())
    per_key = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    everything = per_key.agg(F.sum("_n")).scalar()
    hot = (
        per_key.filter((F.col("_n") > MIN_ROWS) & (F.col("_n") * MAX_HOT_KEYS > everything))
        .select(*key, F.lit(True).alias(HOT), "_n")
    )
    return df.join(F.broadcast(hot), key, "left")


def add_slices(marked: DataFrame, ts: str) -> DataFrame:
    """Add ``_slice`` to marked rows: the hour or minute of ``ts`` for hot keys, else NULL."""
    return marked.withColumn(SLICE, F.when(F.col(HOT), _slice(ts, F.col("_n")))).drop("_n")


def slice_hot_keys(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """``df`` with its hot keys marked and cut; rows that carry marks and slices already stay as they are."""
    if carried(df):
        return df
    return add_slices(mark_hot_keys(df, key), ts)


def carried(df: DataFrame) -> list[str]:
    """The columns of marks and slices, if ``df`` was stored with them."""
    return [HOT, SLICE] if {HOT, SLICE} <= set(df.columns) else []


def slice_equally(df: DataFrame, key: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """Mark hot keys and cut them into slices of about ``rows`` rows each, by rank instead of by the clock.

    The rows of hot keys are range-partitioned by key and ``order`` and written down, so a slice
    is a partition that stays what it is: rows of one minute are cut like any others, and only
    rows that are equal in ``order`` stay together. Spark cuts by a sample; a slice is rarely
    above twice the size. Runs Spark jobs while it is defined: it is made for storing tables.
    """
    rows = rows or MIN_ROWS
    marked = mark_hot_keys(df, key)
    hot = marked.filter(HOT).drop("_n")
    none = F.lit(None).cast("int")
    rest = marked.filter(F.col(HOT).isNull()).drop("_n").withColumn(SLICE, none)
    n = hot.count()
    if not n:
        return rest
    cut = hot.repartitionByRange(-(-n // rows), *key, *_nulls_last(order)).withColumn(SLICE, F.spark_partition_id())
    return rest.unionByName(cut_lineage(cut))


def slice_counted(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The same for rows that already carry the size of their key in ``_n``."""
    return deal_slices(add_slices(df.withColumn(HOT, F.col("_n") > MIN_ROWS), ts), key)


def deal_slices(sliced: DataFrame, key: list[str]) -> DataFrame:
    """Deal rows by key and slice, after a join on the key alone has put each key in one task.

    Spark would keep that partitioning for the window by key and slice, and a hot key whole.
    """
    return sliced.repartition(*key, SLICE)


def slice_if_large(df: DataFrame, size: Column, by: Column) -> DataFrame:
    """Slice all rows by a column when a key may have as many rows as ``size`` says, else none."""
    sliced = df.withColumn(HOT, F.when(size > MIN_ROWS, True))
    return sliced.withColumn(SLICE, F.when(F.col(HOT), by))


def with_next(sliced: DataFrame, key: list[str], order: list[str], take: dict[str, str]) -> DataFrame:
    """Add, per key, values of the following row: ``take`` maps new column -> source column.

    ``sliced`` comes from :func:`slice_hot_keys`, whose time column must be ``order[0]``; its
    helper columns stay, so that a second lookup can follow. The last row of a key gets NULLs.
    """
    part = [*key, SLICE]
    taken = F.struct(*[F.col(src).alias(new) for new, src in take.items()])
    following = F.lead(taken).over(Window.partitionBy(*part).orderBy(*_nulls_last(order)))
    first_rows = (
        sliced.filter(HOT)  # nothing to do, and nothing read, when no key is hot
        .groupBy(*part)
        .agg(F.min_by(taken, _sortable(order)).alias("_first"))
    )
    next_slice = first_rows.select(
        *part,
        F.lead("_first").over(Window.partitionBy(*key).orderBy(SLICE)).alias("_later"),
    )
    linked = sliced.withColumn("_next", following).join(next_slice, part, "left")
    chosen = F.coalesce("_next", "_later")
    return linked.select(
        *[F.col(c) for c in sliced.columns],
        *[chosen.getField(new).alias(new) for new in take],
    )


def with_position(
    sliced: DataFrame, key: list[str], order: list[str], name: str, dense: bool = False
) -> DataFrame:
    """Add the 1-based position per key: row number, or dense rank when ``dense``.

    With ``dense`` the slice must be a function of ``order`` so that equal rows never
    fall into different slices.
    """
    part = [*key, SLICE]
    rank = (F.dense_rank() if dense else F.row_number()).over(Window.partitionBy(*part).orderBy(*_nulls_last(order)))
    hot = sliced.filter(HOT)
    if dense:
        hot = hot.select(*part, *[c for c in order if c not in part]).distinct()
    sizes = hot.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.sum("_n").over(earlier).alias("_before"))
    return (
        sliced.withColumn("_rank", rank)
        .join(offsets, part, "left")
        .select(
            *[F.col(c) for c in sliced.columns],
            (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name),
        )
    )
