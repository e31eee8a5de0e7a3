"""Key checks of a new load: the same violations as over both tables, and old partitions left unread."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from aislelens.operators import new_load

PART = ["y", "m"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table of 12 partitions, written in two loads whose filters are merged."""
    path = str(tmp_path_factory.mktemp("keys") / "t")
    rows = spark.range(6000).select(
        F.col("id").alias("order_id"), (F.col("id") % 7).alias("line"), (F.lit(2020) + F.floor(F.col("id") / 3000)).cast("int").alias("y"),
        (F.floor(F.col("id") / 500) % 6).cast("int").alias("m"),
    )
    rows.write.partitionBy(*PART).parquet(path)
    table = spark.read.parquet(path)
    pieces = new_load.pieces_for(500)
    halves = [new_load.key_filters(table.filter(F.col("order_id") % 2 == i), ["order_id"], PART, pieces) for i in (0, 1)]
    filters = new_load.merged_filters(halves[0].unionByName(halves[1]), PART).cache()
    return table, filters, pieces


def test_same_repeats_as_over_both_tables(spark, stored):
    table, filters, pieces = stored
    ids = [10, 10, 2999, 9000, 9001, 9001, 9001, 5999, None, None]
    new = spark.createDataFrame([(i,) for i in ids], "order_id bigint")
    found = new_load.repeated_keys(new, table, ["order_id"], filters, PART, pieces).collect()
    assert {(r.order_id, r.in_load, r.in_table) for r in found} == {(10, 2, 1), (2999, 1, 1), (9001, 3, 0), (5999, 1, 1)}


def test_many_keys_against_plain_python(spark, stored):
    table, filters, pieces = stored
    ids = [i * 3 for i in range(4000)] + [i * 9 for i in range(300)]
    new = spark.createDataFrame([(i,) for i in ids], "order_id bigint")
    wanted = {(i, n, int(i < 6000)) for i, n in Counter(ids).items() if n > 1 or i < 6000}
    found = new_load.repeated_keys(new, table, ["order_id"], filters, PART, pieces).collect()
    assert {(r.order_id, r.in_load, r.in_table) for r in found} == wanted


def test_partitions_without_hits_are_not_read(spark, stored):
    table, filters, pieces = stored
    new = spark.createDataFrame([(3100,), (3200,)], "order_id bigint")  # both of one partition
    hits = new_load.possible_partitions(new, ["order_id"], filters, PART, pieces).collect()
    assert {(r.y, r.m) for r in hits if r.order_id in (3100, 3200)} >= {(2021, 0)} and len(hits) <= 4
    found = new_load.repeated_keys(new, table, ["order_id"], filters, PART, pieces)
    assert len(found.collect()) == 2
    read = new_load._only(table, PART, [(2021, 0)])
    assert len({r[0] for r in read.select("_metadata.file_path").distinct().collect()}) < len(table.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    unknown = spark.createDataFrame([(10**9 + i,) for i in range(20)], "order_id bigint")
    few = new_load.possible_partitions(unknown, ["order_id"], filters, PART, pieces).count()
    assert few <= 24  # of 240 pairs: one in a hundred by chance


def test_references_without_a_parent(spark, stored):
    table, filters, pieces = stored
    child = spark.createDataFrame([(i,) for i in [5, 5, 7000, 7000, 7001, None, 5999]], "ref bigint")
    found = new_load.unknown_references(child, "ref", table, "order_id", filters, PART, pieces).collect()
    assert {(r.ref, r.rows) for r in found} == {(7000, 2), (7001, 1)}


def test_keys_of_two_columns_and_empty_tables(spark, stored):
    table, _, pieces = stored
    filters = new_load.key_filters(table, ["order_id", "line"], PART, pieces)
    new = spark.createDataFrame([(8, 1), (8, 2), (9, None)], "order_id bigint, line bigint")
    found = new_load.repeated_keys(new, table, ["order_id", "line"], filters, PART, pieces).collect()
    assert [(r.order_id, r.line, r.in_load, r.in_table) for r in found] == [(8, 1, 1, 1)]
    none = new_load.key_filters(table.limit(0), ["order_id", "line"], PART, pieces)
    assert new_load.repeated_keys(new, table.limit(0), ["order_id", "line"], none, PART, pieces).count() == 0
    assert new_load.repeated_keys(new.limit(0), table, ["order_id", "line"], filters, PART, pieces).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_hits_become_rows(spark, stored):
    """A row per key, place and partition made the lookup many times the tables, most of all in filters that are full."""
    _, filters, pieces = stored
    new = spark.range(100_000, 103_000).withColumnRenamed("id", "order_id")
    hits = new_load.possible_partitions(new.unionByName(new), ["order_id"], filters, PART, pieces)
    joins = [line for line in _plan(hits).splitlines() if "Join Inner" in line]
    assert len(joins) == 1 and joins[0].count("getbit") == new_load.WORDS and "Generate" not in _plan(hits)
    assert hits.count() < 3000 * 12 / 20


def test_full_filters_lose_no_key(spark, stored):
    table, _, _ = stored
    many = spark.range(60_000).select(F.col("id").alias("order_id"), F.lit(2020).alias("y"), (F.col("id") % 2).cast("int").alias("m"))
    filters = new_load.key_filters(many, ["order_id"], PART, 1)
    assert "Generate" not in _plan(filters)
    assert filters.count() <= 2 * 64
    new = spark.range(0, 70_000, 7).withColumnRenamed("id", "order_id")
    assert new_load.repeated_keys(new, many, ["order_id"], filters, PART, 1).count() == len(range(0, 60_000, 7))
    unknown = new_load.unknown_references(new, "order_id", many, "order_id", filters, PART, 1)
    assert {r.order_id for r in unknown.collect()} == {*range(0, 70_000, 7)} - {*range(60_000)}


def test_partitions_are_tested_once_a_row_and_may_be_null(spark):
    rows = [(i, None if i % 5 == 0 else 2000 + i % 5, None if i % 7 == 0 else i % 7) for i in range(1, 200)]
    table = spark.createDataFrame(rows, "order_id bigint, y int, m int")
    some = [(None, None), (None, 3), (2001, None), *[(2002, m) for m in range(1, 7)], *[(2003, m) for m in range(1, 7)]]
    read = new_load._only(table, PART, some)
    assert {r.order_id for r in read.collect()} == {i for i, y, m in rows if (y, m) in some}
    derived = table.select("order_id", F.abs("y").alias("y"), "m")
    assert _plan(new_load._only(derived, PART, some)).split("\n")[1].count("abs(") == 1
    filters = new_load.key_filters(table, ["order_id"], PART, 1)
    new = spark.createDataFrame([(i,) for i in range(150, 250)], "order_id bigint")
    assert new_load.repeated_keys(new, table, ["order_id"], filters, PART, 1).count() == 50
