"""Data-quality checks: keys, references, duplicates, ranges and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from aislelens.functions import numeric as N
from aislelens.functions.order_statistics import quantiles
from aislelens.functions.timeline import slice_counted, with_position


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ])


def orphan_orders(orders: DataFrame, customers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Orders that have neither a customer nor a feedback."""
    return orders.join(customers.select("customer_id"), "customer_id", "left_anti").join(
        feedback.select("order_id"), "order_id", "left_anti"
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is not in ``parent``; a NULL key refers to nothing."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def null_violations(required: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table and column that must not be NULL: rows where it is, one pass per table."""
    def check(name: str, df: DataFrame, columns: list[str]) -> DataFrame:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        lines = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in columns])
        return counts.select(F.inline(lines))

    return _union([check(name, *what) for name, what in required.items()])


def key_violations(keys: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table: how many key values are NULL or occur more than once."""
    return _union([
        pk_violations(df, key).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("table_name"), "violations")
        for name, (df, key) in keys.items()
    ])


def fk_violations(checks: list[tuple[str, DataFrame, str, DataFrame]]) -> DataFrame:
    """For each (name, child, key, parent): child rows whose key the parent lacks.

    The child is counted per key before the anti join, so a hot key travels as one row
    per task and the join is on unique keys.
    """
    def check(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
        per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        missing = per_key.join(parent.select(key), key, "left_anti")
        return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
            F.lit(name).alias("constraint_name"), F.lit(key).alias("key"), "violations"
        )

    return _union([check(*c) for c in checks])


def duplicate_rank(df: DataFrame, key: str, ts: str, tie: list[str]) -> DataFrame:
    """Second and later rows of each key, numbered by time.

    Keys that occur once are dropped before anything is sorted; keys with very many rows
    are numbered slice by slice.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    narrow = df.select(*dict.fromkeys([key, ts, *tie]))
    rows = slice_counted(narrow.join(repeated, key), [key], ts)
    ranked = with_position(rows, [key], list(dict.fromkeys([ts, *tie])), "duplicate_rank")
    return ranked.filter("duplicate_rank > 1").select(key, "duplicate_rank")


def pk_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that are NULL or occur more than once."""
    any_null = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | any_null)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def later_dates(df: DataFrame, key: list[str], ts: str, name: str, keep: list[str]) -> DataFrame:
    """Rows dated after the first date of their key, with the dense rank of the date.

    A key with a single date has nothing to report, so min and max per key (combined on
    the map side) discard those before the ranking shuffle.
    """
    several = (
        df.groupBy(*key)
        .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n"))
        .filter("_lo < _hi")
        .select(*key, "_n")
    )
    rows = slice_counted(df.select(*dict.fromkeys([*key, ts, *keep])).join(several, key), key, ts)
    return with_position(rows, key, [ts], name, dense=True).filter(F.col(name) > 1).select(*keep, name)


def dup_feedback_dates(feedback: DataFrame) -> DataFrame:
    keep = ["customer_id", "feedback_id", "feedback_date", "feedback_text"]
    return later_dates(feedback, ["customer_id", "feedback_id"], "feedback_date", "dupl_cnt", keep)


def dup_customer_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    later = later_dates(
        orders, ["customer_id", "order_id"], "order_date", "ord_dupl_check", ["customer_id", "order_id"]
    )
    return later.join(customers.select("customer_id"), "customer_id", "left_semi")


def feedback_cardinality(feedback: DataFrame) -> DataFrame:
    per_customer = feedback.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.agg(
        F.sum("n").alias("rows_count"), F.count("customer_id").alias("original_cust_count")
    )


def range_checks(
    df: DataFrame, column: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Rows whose value lies below ``low`` or above ``high``."""
    tests = []
    if low is not None:
        tests.append(F.col(column) < low)
    if high is not None:
        tests.append(F.col(column) > high)
    return df.filter(reduce(Column.__or__, tests))


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count and percentage of every column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns])
    return counts.select("_rows", F.inline(per_column)).select(
        "column_name", "null_count", N.percent("null_count", "_rows").alias("null_pct")
    )


def _told(value: Column, kind: DataType) -> list[Column]:
    """What a hash must see to tell a value from all others: Spark's hashes pass over NULLs, also inside of arrays."""
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value))
        return _told(entries, ArrayType(StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)])))
    if isinstance(kind, ArrayType):
        return [value.isNull(), F.size(value), F.transform(value, lambda x: F.xxhash64(*_told(x, kind.elementType)))]
    if isinstance(kind, StructType):
        return [value.isNull(), *[part for f in kind for part in _told(value.getField(f.name), f.dataType)]]
    return [value.isNull(), value]


def _fingerprint(df: DataFrame, columns: list[str], seed: int) -> Column:
    """64 bits of a row."""
    return F.xxhash64(F.lit(seed), *[part for c in columns for part in _told(F.col(f"`{c}`"), df.schema[c].dataType)])


#: Seeds of the fingerprints by which rows are grouped, and of those that tell different rows apart.
GROUPED_BY, TOLD_BY = (0, 1), (2, 3)


def row_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one, over all columns or a subset.

    Rows are counted by a fingerprint of 128 bits, so what is shuffled does not grow with the
    width of a row. A second, independent fingerprint tells whether different rows share the
    first; only such rows, if there are any, are compared by all their columns.
    """
    columns = subset or df.columns
    keys = [f"_print{i}" for i in GROUPED_BY]
    marked = df.withColumns({k: _fingerprint(df, columns, i) for k, i in zip(keys, GROUPED_BY)})
    ends = {f"_{name}{i}": end(_fingerprint(df, columns, i)) for i in TOLD_BY for name, end in (("low", F.min), ("high", F.max))}
    groups = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in ends.items()])
    one_row = reduce(Column.__and__, [F.col(f"_low{i}") == F.col(f"_high{i}") for i in TOLD_BY])
    alike = groups.filter(one_row).agg(F.sum(F.col("n") - 1).alias("n"))
    shared = marked.join(groups.filter(~one_row).select(*keys), keys, "left_semi")
    compared = shared.groupBy(*[f"`{c}`" for c in columns]).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("n"))
    return alike.unionByName(compared).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_count"))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per column."""
    moments = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[
        measure(F.col(c).cast("double")).alias(f"{name} {c}") for c in columns for name, measure in moments.items()
    ])

    def line(column: str) -> Column:
        return F.struct(F.lit(column).alias("column_name"), *[F.col(f"{name} {column}").alias(name) for name in moments])

    lines = wide.select(F.inline(F.array(*map(line, columns))))
    return lines.join(quantiles(df, columns, [0.25, 0.5, 0.75]), "column_name", "left").select(
        "column_name", "count", *[N.half_up(c, 6).alias(c) for c in ("mean", "std")], "min",
        *[N.half_up(q, 6).alias(c) for c, q in (("q25", "q0"), ("q50", "q1"), ("q75", "q2"))], "max",
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).distinct()
