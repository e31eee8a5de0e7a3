import zlib
from collections import defaultdict

import pytest
from frames import AWKWARD, documents

from aislelens.llm import queries, sharding

SF = "/root/testdata/sf0.01"


def plain(rows, shards):
    """(doc_id, size, crc) to (shard, slot) by one pass over the sorted rows."""
    keyed = sorted(
        ((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), i) for i, t in rows)
    )
    total, before, used, out = sum(k[2] for k in keyed), 0, defaultdict(int), []
    for _, _, size, crc, i in keyed:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, crc, shard, used[shard]))
        used[shard] += 1
        before += size
    return sorted(out, key=str)


def test_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_sharding(spark, SF).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain(rows, 40)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_awkward_and_repeated_rows(spark):
    rows = [r[:2] for r in AWKWARD] + [(50, "same")] * 300 + [(None, "same")] * 20
    got = sharding.assign(documents(spark, rows, clashing=True), shards=5).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str) == plain(rows, 5)


def test_empty_table(spark):
    assert sharding.assign(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, "word " * (i % 40)) for i in range(200)] + [(None, "x")]
    docs = documents(spark, rows, clashing=True)
    with pytest.raises(ValueError, match="shard"):
        sharding.write_shards(docs, str(tmp_path / "no"), shards=7)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=7, column="place")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "place"}
    wanted = {(i, c): s for i, _, c, s, _ in plain(rows, 7)}
    found = back.collect()
    assert len(found) == len(rows)
    assert all(r.place == wanted[(r.doc_id, zlib.crc32(r.text.encode()))] and r.shard == r._key == r.key == "x" for r in found)
