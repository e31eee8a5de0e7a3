"""Loads that run again or stop halfway, and files with bad records among good ones."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from aislelens.plans import ingest
from aislelens.sources import loads

SCHEMA = "id bigint, day date, price decimal(8,2), name string"


def table(spark, rows):
    return spark.createDataFrame([(i, i % 3, f"v{v}") for i, v in rows], "id bigint, part int, value string")


def content(spark, target):
    return Counter(tuple(r) for r in loads.read_loads(spark, target).select("id", "part", "value", "load_id").collect())


def wanted(**by_load):
    return Counter((i, i % 3, f"v{v}", name) for name, rows in by_load.items() for i, v in rows)


def test_a_load_that_runs_again_leaves_the_table_as_once(spark, tmp_path):
    target, first, second = str(tmp_path / "t"), [(i, 0) for i in range(9)], [(i, 1) for i in range(4, 20)]
    for name, rows in (("a", first), ("b", second), ("a", first), ("a", first)):
        report = loads.load(table(spark, rows), target, name, partition_by=["part"])
        assert (report.rows, report.partitions) == (len(rows), 3)
    assert content(spark, target) == wanted(a=first, b=second)


def test_a_repeat_with_other_rows_replaces_all_of_the_load(spark, tmp_path):
    target, kept = str(tmp_path / "t"), [(1, 1), (2, 1)]
    loads.load(table(spark, kept), target, "b", partition_by=["part"])
    loads.load(table(spark, [(i, 0) for i in range(9)]), target, "a", partition_by=["part"])
    loads.load(table(spark, [(3, 5), (6, 5)]), target, "a", partition_by=["part"])  # one partition of three
    assert content(spark, target) == wanted(a=[(3, 5), (6, 5)], b=kept)
    assert loads.load(table(spark, []), target, "a", partition_by=["part"]).partitions == 0
    assert content(spark, target) == wanted(b=kept)


@pytest.mark.parametrize("moves", [0, 1, 2])
@pytest.mark.parametrize("before", [False, True])
def test_a_load_stopped_while_it_is_published(spark, tmp_path, monkeypatch, moves, before):
    target, other, rows = str(tmp_path / "t"), [(7, 7), (8, 7)], [(i, 0) for i in range(30)]
    loads.load(table(spark, other), target, "b", partition_by=["part"])
    if before:
        loads.load(table(spark, [(i, 9) for i in range(4)]), target, "a", partition_by=["part"])
    move, done = loads._Folders.move, []

    def stops(self, source, place):
        if len(done) == moves:
            raise KeyboardInterrupt
        done.append(place)
        move(self, source, place)

    with monkeypatch.context() as patch:
        patch.setattr(loads._Folders, "move", stops)
        with pytest.raises(KeyboardInterrupt):
            loads.load(table(spark, rows), target, "a", partition_by=["part"])
    assert sum(n for r, n in content(spark, target).items() if r[3] == "b") == 2  # other loads are not touched
    loads.load(table(spark, rows), target, "a", partition_by=["part"])
    assert content(spark, target) == wanted(a=rows, b=other)


def test_a_load_that_fails_while_it_is_written_publishes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    loads.load(table(spark, [(1, 1)]), target, "b")
    bad = table(spark, [(i, 0) for i in range(9)]).withColumn("value", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        loads.load(bad, target, "a")
    assert content(spark, target) == wanted(b=[(1, 1)])


@pytest.mark.parametrize("name", ["", "a/b", "../x", "_a", ".a", "a=b", "a b"])
def test_load_ids_are_names_of_folders(spark, tmp_path, name):
    with pytest.raises(ValueError, match="load id"):
        loads.load(table(spark, [(1, 1)]), str(tmp_path / "t"), name)
    with pytest.raises(ValueError, match="load_id"):
        loads.load(table(spark, [(1, 1)]).withColumn("load_id", F.lit("x")), str(tmp_path / "t"), "a")


GOOD = 'id,day,price,name\n1,2024-01-01,2.50,plain\n2,2024-01-02,3.00,"with, comma"\n'
MIXED = "id,day,price,name\n3,2024-02-01,4.00,ok\nx4,2024-02-01,4.00,bad id\n5,2024-13-01,many,two faults\n6,2024-01-01\n,2024-01-01,1.00,no id\n7,,,\n"
OTHER_HEADER = "id,price,day,name\n8,2024-01-01,1.00,looks fine\n9,2024-01-01,1.00,this too\n"


def deliver(tmp_path, **files):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name} file.csv").write_text(text)
    return str(folder)


def load_all(spark, tmp_path, path, **more):
    return loads.load_files(spark, path, SCHEMA, str(tmp_path / "t"), "l1", rejects=str(tmp_path / "r"), required=["id"], **more)


def test_a_bad_file_among_good_ones(spark, tmp_path):
    path = deliver(tmp_path, good=GOOD, mixed=MIXED, other=OTHER_HEADER)
    for _ in range(2):
        report = load_all(spark, tmp_path, path)
        assert (report.rows, report.rejects) == (4, 6 + 1)  # records and the foreign header line
        rows = loads.read_loads(spark, str(tmp_path / "t"))
        assert rows.columns == ["id", "day", "price", "name", "load_id"]
        assert sorted((r.id, str(r.day), str(r.price), r.name) for r in rows.collect()) == [
            (1, "2024-01-01", "2.50", "plain"), (2, "2024-01-02", "3.00", "with, comma"), (3, "2024-02-01", "4.00", "ok"), (7, "None", "None", None),
        ]
        rejects = loads.read_rejects(spark, str(tmp_path / "r")).collect()
        found = Counter((r.file.rsplit("/", 1)[-1].replace("%20", " ").split()[0], r.reason) for r in rejects)
        assert found == Counter({
            ("mixed", "id is no bigint: x4"): 1, ("mixed", "day is no date: 2024-13-01; price is no decimal(8,2): many"): 1,
            ("mixed", "another number of fields"): 1, ("mixed", "id is missing"): 1, ("other", "the file has another header"): 3,
        })
        assert {"x4,2024-02-01,4.00,bad id", "6,2024-01-01"} <= {r.record for r in rejects}


def test_counts_add_up_over_partitions(spark, tmp_path):
    lines = [f"{i},2024-01-{1 + i % 28:02},{'x' if i % 7 == 0 else i}.00,n" for i in range(500)]
    path = deliver(tmp_path, a="\n".join(["id,day,price,name", *lines[:300]]), b="\n".join(["ID, day,price,name", *lines[300:]]))
    report = load_all(spark, tmp_path, path, partition_by=["week"], clean=lambda df: df.withColumn("week", F.weekofyear("day")))
    assert report.rows + report.rejects == 500 and report.rejects == sum(i % 7 == 0 for i in range(500))
    assert loads.read_loads(spark, str(tmp_path / "t")).count() == report.rows
    assert loads.read_rejects(spark, str(tmp_path / "r")).count() == report.rejects


@pytest.mark.parametrize("share,stops", [(0.0, True), (0.3, True), (0.7, False)])
def test_too_many_rejects_publish_nothing(spark, tmp_path, share, stops):
    path = deliver(tmp_path, mixed=MIXED, good=GOOD)
    if stops:
        with pytest.raises(loads.TooManyRejects, match="4 of 8"):
            load_all(spark, tmp_path, path, max_reject_share=share)
        assert not (tmp_path / "t").exists() or not [p for p in (tmp_path / "t").rglob("*.parquet")]
    else:
        assert load_all(spark, tmp_path, path, max_reject_share=share).rows == 4


def test_a_clean_load_has_no_rejects(spark, tmp_path):
    report = load_all(spark, tmp_path, deliver(tmp_path, good=GOOD), max_reject_share=0.0)
    assert (report.rows, report.rejects) == (2, 0) and not (tmp_path / "r").exists()


def test_ingest_with_a_load_id(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "part.csv").write_text("order_id,product_id,quantity,unit_price\n1,2,3,4.50\n2,,1,1.00\n")
    for _ in range(2):
        report = ingest.ingest(spark, {"order_items": str(folder)}, str(tmp_path / "tables"), load_id="day1", max_reject_share=0.5)["order_items"]
        assert (report.rows, report.rejects) == (1, 1)
    stored = ingest.StoredTables(spark, str(tmp_path / "tables"))
    assert [tuple(r) for r in stored.items.collect()] == [(1, 2, 3, stored.items.first().unit_price)]
    with pytest.raises(loads.TooManyRejects):
        ingest.ingest(spark, {"order_items": str(folder)}, str(tmp_path / "tables"), load_id="day2")
