"""Exact ranks, quantiles and tiles against sorting in plain Python."""

import random
from decimal import Decimal
from math import inf, nan

import numpy as np
import pytest

from aislelens.functions import order_statistics as stats
from aislelens.operators import product, quality
from aislelens.plans import catalog
from aislelens.sources.retail import RetailTables


def _values(kind: str) -> list:
    rnd = random.Random(kind)
    return {
        "spread": [rnd.uniform(-1e6, 1e6) for _ in range(500)],
        "one value": [7.5] * 300,
        "heavy tie": [1.0] * 400 + [rnd.gauss(0, 1) for _ in range(100)],
        "long tail": [rnd.paretovariate(0.3) for _ in range(400)],
        "few": [3.0, 1.0, 2.0],
        "single": [42.0],
    }[kind]


@pytest.fixture(params=["one task", "steps"])
def way(request, monkeypatch):
    if request.param == "steps":
        monkeypatch.setattr(stats, "SMALL_BYTES", 0)


def quantiles(df, column, probs):
    rows = stats.quantiles(df, [column], probs).collect()
    return list(rows[0])[1:] if rows else None


@pytest.mark.parametrize("kind", ["spread", "one value", "heavy tie", "long tail", "few", "single"])
def test_quantiles(spark, way, kind):
    values = _values(kind)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    assert quantiles(df, "x", probs) == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)


def test_quantiles_of_several_columns_in_one_pass(spark, way):
    rows = [(i, float(i % 5), None, Decimal(i) / 3) for i in range(40)]
    df = spark.createDataFrame(rows, "a bigint, b double, c int, d decimal(20,6)")
    found = {r.column_name: (r.q0, r.q1) for r in stats.quantiles(df, ["a", "b", "c", "d"], [0.5, 1.0]).collect()}
    assert found == {"a": (19.5, 39.0), "b": (2.0, 4.0), "d": (pytest.approx(6.5), pytest.approx(13.0))}


def test_quantiles_with_infinities_and_nan(spark, way):
    values = [float(i) for i in range(500)] + [inf, -inf, nan, -0.0, 5e-324, -5e-324, 1e308, -1e308]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, key=lambda v: (v != v, v if v == v else 0))
    n = len(values) - 1
    got = quantiles(df, "v", [i / n for i in range(0, n + 1, 13)] + [1.0])
    assert got[:-1] == pytest.approx([ordered[i] for i in range(0, n + 1, 13)], abs=1e-9, nan_ok=True) and got[-1] != got[-1]
    assert quantiles(df, "v", [0.0, (n - 1) / n]) == [-inf, inf]


def test_with_quantiles(spark, way):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)] + [(9, None)], "id int, x double")
    assert {(r.low, r.high) for r in stats.with_quantiles(df, "x", {"low": 0.25, "high": 0.75}).collect()} == {(2.0, 6.0)}
    assert stats.with_quantiles(df.filter("x is null"), "x", {"low": 0.25}).count() == 0


def test_wide_integers_stay_exact(spark, way):
    values = [2**60 + i for i in range(50)] + [-(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x bigint").repartition(4)
    got = {r.id: r.t for r in stats.with_tiles(df, len(values), {"x": "t"}, "id").collect()}
    ordered = sorted(range(len(values)), key=lambda i: -values[i])
    assert [got[i] for i in ordered] == list(range(1, len(values) + 1))


def tiles_of(ordered, tiles):
    small, more = divmod(len(ordered), tiles)
    numbers = [t + 1 for t in range(tiles) for _ in range(small + (t < more))]
    return dict(zip(ordered, numbers))


@pytest.mark.parametrize("rows", [0, 1, 3, 4, 5, 6, 23, 200])
@pytest.mark.parametrize("distinct", [1, 3, 10**6])
def test_tiles(spark, way, rows, distinct):
    rnd = random.Random(rows * distinct)
    data = [(rnd.randrange(10**12) * 300 + i, Decimal(rnd.randrange(distinct)) / 100) for i in range(rows)]
    df = spark.createDataFrame(data, "id bigint, v decimal(28,2)").repartition(3)
    got = {r["id"]: r["tile"] for r in stats.with_tiles(df, 5, {"v": "tile"}, "id").collect()}
    assert got == tiles_of([i for i, _ in sorted(data, key=lambda r: (-r[1], r[0]))], 5)


def test_tiles_of_two_columns_with_rows_without_value(spark, way):
    for n, missing, tiles in ((10, 5, 5), (3, 9, 4), (0, 4, 3), (7, 1, 3), (40, 0, 1)):
        rows = [(i, float(i * 3 % 7), i % 4) for i in range(n)] + [(100 + i, None, i % 2) for i in range(missing)]
        df = stats.with_tiles(spark.createDataFrame(rows, "id int, v double, w int"), tiles, {"v": "tv", "w": "tw"}, "id")
        by_v = tiles_of([r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))], tiles)
        by_w = tiles_of([r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))], tiles)
        assert {r.id: (r.tv, r.tw) for r in df.collect()} == {i: (by_v[i], by_w[i]) for i in by_v}


def test_defining_runs_no_job_and_the_result_follows_the_data(spark, way, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id as double) as x").write.parquet(path)
    sc = spark.sparkContext
    table = spark.read.parquet(path)
    sc.setJobGroup("defined", "ranks")
    try:
        tiles = stats.with_tiles(table, 4, {"x": "t"}, "id")
        inliers = product.iqr_inliers(table, "x")
        lines = quality.describe_numeric(table, ["id", "x"])
        assert list(sc.statusTracker().getJobIdsForGroup("defined")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tiles.filter("t = 1").count() == 25 and inliers.count() == 100 and {r.q50 for r in lines.collect()} == {49.5}


def test_a_job_on_the_retail_tables_defines_without_jobs(spark, way):
    tables, sc = RetailTables(spark, "/root/testdata/sf0.001"), spark.sparkContext
    tables.orders, tables.customers, tables.delivery  # reading the schema of a file is a job
    catalog.JOBS["iqr_inliers"](tables)
    sc.setJobGroup("jobs", "ranks")
    try:
        for name in ("rfm_ntile_segments", "describe_numeric", "describe_delivery", "iqr_inliers_orders"):
            catalog.JOBS[name](tables)
        assert list(sc.statusTracker().getJobIdsForGroup("jobs")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_only_one_row_per_rank_goes_from_step_to_step(spark, monkeypatch):
    """Whatever the number of rows, a join between steps has at most one row per wanted rank on its small side."""
    monkeypatch.setattr(stats, "SMALL_BYTES", 0)
    df = spark.range(20_000).selectExpr("id", "cast(id * id as double) as x")
    plan = stats.quantiles(df, ["x"], [0.5, 0.9])._jdf.queryExecution().executedPlan().toString()
    assert "Range" in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 1
    assert quantiles(df, "x", [0.5, 0.9]) == pytest.approx(list(np.quantile([i * i for i in range(20_000)], [0.5, 0.9])))
