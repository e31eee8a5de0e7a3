"""Tables stored for lookups along a timeline: no shuffle under the window, hot keys cut by rank."""

from collections import Counter
from datetime import datetime, timedelta

import pytest

from aislelens.functions import timeline
from aislelens.plans import catalog, ingest
from aislelens.sources import layout
from aislelens.sources.retail import RetailTables

JOBS = """late_penalty churn_after_delivery revenue_leakage delay_vs_next_value recovered_delivery_pct next_product_symmetry
next_category_propensity next_category_demand triple_repeat_product churn_after_bad_review""".split()
NO_SHUFFLE = ["late_penalty", "churn_after_delivery", "revenue_leakage", "delay_vs_next_value", "recovered_delivery_pct"]


@pytest.fixture(scope="module", params=[10**6, 3], ids=["no hot keys", "every busy customer hot"])
def stored(request, spark, tmp_path_factory):
    """Orders as they are stored, with the limit above which a key is hot."""
    folder, given = tmp_path_factory.mktemp("tables"), RetailTables(spark, "/root/testdata/sf0.001")
    for name in ("orders", "customers", "feedback", "products", "delivery"):
        getattr(given, name).write.parquet(str(folder / name))
    given.items.write.parquet(str(folder / "order_items"))
    table = f"order_timeline_{request.param}"
    before, timeline.MIN_ROWS = timeline.MIN_ROWS, request.param
    try:
        ingest.store_order_timeline(spark, str(folder), table, buckets=4)
    finally:
        timeline.MIN_ROWS = before
    yield given, ingest.StoredTables(spark, str(folder), table), request.param
    spark.sql(f"drop table {table}")


def under_windows(plan: str) -> list[str]:
    """Operators below the first window of each branch that has one, of a physical plan's text."""
    found, depth = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :+-|*"))
        if depth is not None and indent <= depth:
            depth = None
        if depth is not None:
            found.append(line)
        elif " Window [" in line:
            depth = indent
    return found


@pytest.mark.parametrize("name", JOBS)
def test_same_results_as_without_the_layout(stored, name):
    given, tables, _ = stored
    ours, theirs = (Counter(map(tuple, catalog.JOBS[name](t).collect())) for t in (tables, given))
    assert ours == theirs and (ours or name in ("triple_repeat_product", "next_product_symmetry"))


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_shuffle_under_the_window(spark, stored, name):
    _, tables, _ = stored
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.JOBS[name](tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    rows = plan[: plan.index("_first")] if "_first" in plan else plan  # the window over whole rows, not the one over slices
    below = under_windows(plan)
    main = [line for line in below if "Exchange" in line and "_slice" in line and "lead" not in line]
    assert "Window" in rows and "Bucketed: true" in plan and not main, plan


def test_hot_customers_are_marked_when_stored(stored):
    _, tables, limit = stored
    sizes = [r.rows for r in layout.slice_sizes(tables.timeline, ["customer_id"]).collect()]
    assert bool(sizes) == (limit == 3)
    assert tables.timeline.count() == tables.orders.count()
    assert not {timeline.HOT, timeline.SLICE} & set(tables.orders.columns)


def test_a_stored_timeline_is_declared_in_another_catalogue(spark, stored, tmp_path):
    _, tables, _ = stored
    path = f"{tables.folder}/order_timeline"
    layout.declare_timeline(spark, "declared_again", path, key=["customer_id"], buckets=4)
    again = ingest.StoredTables(spark, tables.folder, "declared_again")
    assert Counter(map(tuple, catalog.JOBS["late_penalty"](again).collect())) == Counter(map(tuple, catalog.JOBS["late_penalty"](tables).collect()))
    assert "Bucketed: true" in again.timeline.groupBy("customer_id", timeline.SLICE).count()._jdf.queryExecution().executedPlan().toString()
    spark.sql("drop table declared_again")


START = datetime(2024, 5, 1, 10, 30)


@pytest.mark.parametrize("limit", [1, 50, 400, 10**6])
def test_all_rows_of_a_key_in_one_minute(spark, monkeypatch, limit):
    """No slice is much above its size, and the next row does not depend on it."""
    rows = [(7, START + timedelta(microseconds=37 * i), i) for i in range(1500)] + [(k, START + timedelta(hours=k), k) for k in range(20)]
    rows += [(8, None, 5), (None, START, 6), (9, START, 1), (9, START, 2), (9, START, 3)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id int").repartition(5)
    monkeypatch.setattr(timeline, "MIN_ROWS", limit)
    sliced = timeline.slice_equally(df, ["k"], ["ts", "id"])
    sizes = [r.rows for r in layout.slice_sizes(sliced, ["k"]).collect()]
    assert (max(sizes) <= 3 * limit + 5) if limit < 1500 else not sizes
    found = timeline.with_next(sliced, ["k"], ["ts", "id"], {"after": "id"}).collect()
    by_key = {}
    for k, ts, i in rows:
        by_key.setdefault(k, []).append((ts is None, ts or START, i))
    want = Counter()
    for k, own in by_key.items():
        own.sort()
        want.update((k, a[2], b[2] if b else None) for a, b in zip(own, [*own[1:], None]))
    assert Counter((r.k, r.id, r.after) for r in found if r.k is not None) == Counter({w: n for w, n in want.items() if w[0] is not None})
    placed = timeline.with_position(sliced, ["k"], ["ts", "id"], "place").filter("k = 7").collect()
    assert sorted(r.place for r in placed) == list(range(1, len(by_key[7]) + 1))


def test_equal_rows_stay_together_for_a_dense_rank(spark, monkeypatch):
    monkeypatch.setattr(timeline, "MIN_ROWS", 4)
    df = spark.createDataFrame([(1, START + timedelta(seconds=i // 10)) for i in range(100)], "k int, ts timestamp_ntz").repartition(3)
    ranked = timeline.with_position(timeline.slice_equally(df, ["k"], ["ts"]), ["k"], ["ts"], "r", dense=True)
    assert Counter(r.r for r in ranked.collect()) == Counter({i: 10 for i in range(1, 11)})
