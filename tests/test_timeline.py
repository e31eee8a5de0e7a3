"""Next-row and position lookups against plain Python, with and without hot keys."""

import datetime as dt
import random

import pytest

from aislelens.functions import timeline

START = dt.datetime(2024, 1, 1)


def _events(seed: int, hot_share: float, n: int = 400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < hot_share else rnd.randint(1, 30)
        when = START + dt.timedelta(minutes=rnd.choice([rnd.randint(0, 600), 60, 61, 3600]), seconds=rnd.randint(0, 59))
        rows.append((key, when, i, f"v{i}"))
    rnd.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k int, t timestamp_ntz, id int, v string").repartition(7)


def _by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.mark.parametrize("min_rows", [0, 5, 10**9])
@pytest.mark.parametrize("huge", [3, 10**9])
@pytest.mark.parametrize("seed,hot_share", [(1, 0.0), (2, 0.4), (3, 0.95)])
def test_next_twice(spark, monkeypatch, seed, hot_share, min_rows, huge):
    monkeypatch.setattr(timeline, "MIN_ROWS", min_rows)
    monkeypatch.setattr(timeline, "HUGE", huge)
    rows = _events(seed, hot_share)
    sliced = timeline.slice_hot_keys(_frame(spark, rows), ["k"], "t")
    once = timeline.with_next(sliced, ["k"], ["t", "id"], {"v1": "v", "t1": "t"})
    twice = timeline.with_next(once, ["k"], ["t", "id"], {"v2": "v1"})
    got = {r["id"]: (r["v1"], r["t1"], r["v2"]) for r in twice.collect()}
    want = {}
    for group in _by_key(rows).values():
        for i, r in enumerate(group):
            one = group[i + 1] if i + 1 < len(group) else (None,) * 4
            two = group[i + 2] if i + 2 < len(group) else (None,) * 4
            want[r[2]] = (one[3], one[1], two[3])
    assert got == want


@pytest.mark.parametrize("min_rows", [0, 10**9])
@pytest.mark.parametrize("dense", [False, True])
def test_position(spark, monkeypatch, dense, min_rows):
    monkeypatch.setattr(timeline, "MIN_ROWS", min_rows)
    rows = _events(4, 0.5)
    sliced = timeline.slice_hot_keys(_frame(spark, rows), ["k"], "t")
    order = ["t"] if dense else ["t", "id"]
    got = {r["id"]: r["p"] for r in timeline.with_position(sliced, ["k"], order, "p", dense).collect()}
    want = {}
    for group in _by_key(rows).values():
        days = sorted({r[1] for r in group})
        for i, r in enumerate(group):
            want[r[2]] = days.index(r[1]) + 1 if dense else i + 1
    assert got == want


def test_only_keys_above_both_limits_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(timeline, "MIN_ROWS", 10)
    monkeypatch.setattr(timeline, "MAX_HOT_KEYS", 2)
    rows = [(1, START, i, "") for i in range(70)] + [(2, START, 100 + i, "") for i in range(30)]
    sliced = timeline.slice_hot_keys(_frame(spark, rows), ["k"], "t")
    assert {(r["k"], r["_slice"] is not None) for r in sliced.collect()} == {(1, True), (2, False)}


def test_no_hot_key_leaves_a_single_window_shuffle(spark):
    sliced = timeline.slice_hot_keys(_frame(spark, _events(5, 0.2)), ["k"], "t")
    df = timeline.with_next(sliced, ["k"], ["t", "id"], {"v1": "v"})
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in final and "min_by" not in final
