"""States of loads that merge, and whole-row duplicates by fingerprint."""

from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from aislelens.operators import cohort, customer, quality, state

ORDERS = "order_id bigint, customer_id bigint, order_date timestamp_ntz, order_total decimal(18,2)"


def orders(spark, numbers):
    rows = [(i, None if i % 11 == 0 else i % 7, datetime(2024, 1, 1) + timedelta(days=5 * i, hours=i), Decimal(i) / 4) for i in numbers]
    return spark.createDataFrame(rows, ORDERS)


@pytest.mark.parametrize("split", [lambda i: i % 2, lambda i: i > 60, lambda i: i < 30, lambda i: 0])  # mixed, in order, late rows, one empty
def test_state_after_two_loads_equals_the_query_over_all_rows(spark, tmp_path, split):
    numbers, target = range(100), str(tmp_path / "state")
    for part in (0, 1):
        state.add_load(orders(spark, [i for i in numbers if int(split(i)) == part]), target, f"load{part}")
    both, whole = state.stored(spark, target), orders(spark, numbers)
    customers = spark.createDataFrame([(i,) for i in range(6)], "customer_id bigint")
    for ours, theirs in (
        (cohort.retention_of(state.active_months(both)), cohort.cohort_retention(whole)),
        (customer.rfm_bins_of(both, customers), customer.rfm_fixed_bins(whole, customers)),
        (state.repeat_customer_pct(both), customer.repeat_customer_pct(whole)),
    ):
        a, b = (Counter(map(tuple, df.collect())) for df in (ours, theirs))
        assert a and a == b


def test_a_load_that_runs_again_counts_once(spark, tmp_path):
    target = str(tmp_path / "state")
    for name, numbers in (("a", range(50)), ("b", range(50, 80)), ("a", range(40))):
        state.add_load(orders(spark, numbers), target, name)
    assert state.stored(spark, target).agg({"frequency": "sum"}).first()[0] == 70


def test_merging_is_associative(spark):
    parts = [state.customer_state(orders(spark, range(i, 90, 3))) for i in range(3)]
    at_once = state.merged_of(parts)
    stepwise = state.merged_of([state.merged_of(parts[:2]), parts[2]])
    rows = [Counter((r.customer_id, tuple(sorted(r.months)), r.last_day, r.frequency, r.monetary) for r in df.collect()) for df in (at_once, stepwise)]
    assert rows[0] == rows[1]


WIDE = "a int, b string, c double, d array<int>, `e.f` string"
ROWS = [(1, "x", 1.0, [1], "p"), (1, "x", 1.0, [1], "p"), (1, None, 1.0, [1], "p"), (None, "1", 1.0, [1], "p"), (1, "x", -0.0, None, "p"),
        (1, "x", 0.0, None, "p"), (1, "x", float("nan"), [], None), (1, "x", float("nan"), [], None), (1, "x", None, [None], None), (1, "x", None, [], None)]


@pytest.mark.parametrize("collide", ["no", "half", "all"])
def test_row_duplicates_with_forced_collisions(spark, monkeypatch, collide):
    df = spark.createDataFrame(ROWS * 2, WIDE).repartition(4)
    own = quality._fingerprint
    if collide != "no":
        weak = quality.F.lit(7) if collide == "all" else quality.F.pmod(quality.F.xxhash64("a", "c"), quality.F.lit(2))
        monkeypatch.setattr(quality, "_fingerprint", lambda df, columns, seed: weak.cast("bigint") if seed in quality.GROUPED_BY else own(df, columns, seed))
    for subset in (None, ["a", "b"], ["e.f"], ["c"]):
        columns = [f"`{c}`" for c in (subset or df.columns)]
        wanted = df.count() - df.select(*columns).distinct().count()
        assert quality.row_duplicates(df, subset).first().duplicate_count == wanted
    assert quality.row_duplicates(df.limit(0)).first().duplicate_count == 0


def test_nulls_inside_of_nested_values_count(spark):
    kind = "s struct<a: int, b: array<struct<c: string>>>, m map<string, int>"
    rows = [((1, [("x",)]), {"k": 1}), ((1, [("x",), (None,)]), {"k": 1}), ((1, [(None,), ("x",)]), {"k": 1}), ((1, [None, ("x",)]), {"k": 1}),
            ((None, [("x",)]), {"k": 1}), (None, {"k": 1}), ((1, [("x",)]), {"k": None}), ((1, [("x",)]), {}), ((1, [("x",)]), None)]
    assert quality.row_duplicates(spark.createDataFrame(rows * 3, kind)).first().duplicate_count == 2 * len(rows)


def test_wide_rows_are_not_shuffled(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 5000) as wide").repartition(2)
    plan = quality.row_duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [_print0" in line)
    assert "wide" not in aggregate.split("],")[0]
