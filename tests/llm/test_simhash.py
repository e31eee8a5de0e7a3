import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from frames import AWKWARD, documents

from aislelens.llm import components, simhash

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(A_TO_Z))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Smallest member of every node's group."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = defaultdict(list)
    for r in rows:
        fps[plain_fingerprint(r[1])].append(r[0])
    values = sorted(fps)
    root = groups(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4])
    least = defaultdict(list)
    for v in values:
        least[root[v]] += [i for i in fps[v] if i is not None]
    return Counter((i, f"{v:016x}", min(least[root[v]], default=None)) for v, ids in fps.items() for i in ids)


def test_documents_with_near_copies(spark):
    draw = random.Random(8)
    rows = list(AWKWARD[:-3])
    for g in range(30):
        words = [f"w{draw.randrange(500)}" for _ in range(draw.choice([3, 60, 400]))]
        for _ in range(draw.randrange(1, 6)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(50)}"
            rows.append((1000 + len(rows), " ".join(words).upper() if draw.random() < 0.3 else " ".join(words)))
    got = simhash.near_duplicates(documents(spark, rows, clashing=True)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected(rows)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = documents(spark, [(5, text), (2, text), (9, text + " end"), (4, "other text"), (None, "no id")], clashing=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == sorted([text, "other text", "no id"])


def test_each_text_of_a_repeated_id_is_judged_by_itself(spark):
    """The smallest id of a group stays; without ids the smallest hash of a text; no clean text goes."""
    near = [" ".join([*(f"w{i}" for i in range(400)), f"end{n}"]) for n in range(6)]
    rows = [(1, near[0]), (2, near[1]), (2, "a clean text of its own"), (None, near[2]), (None, "another clean text"), (3, "third"), (3, "fourth")]
    kept = Counter((r.doc_id, r.text) for r in simhash.one_of_each(documents(spark, rows, clashing=True)).collect())
    assert kept == Counter([rows[0], rows[2], rows[4], rows[5], rows[6]])
    unnamed = [(None, t) for t in near[:4]] + [(None, None)]
    kept = [r.text for r in simhash.one_of_each(documents(spark, unnamed)).collect()]
    assert len(kept) == 2 and None in kept and min(near[:4], key=lambda t: hashlib.md5(t.encode()).hexdigest()) in kept
    alone = [(9, near[0]), (9, near[1]), (9, near[1])]  # one id, near copies: one of its texts stays
    kept = {r.text for r in simhash.one_of_each(documents(spark, alone)).collect()}
    assert len(kept) == 1


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_a_frequent_key_lies_in_several_tasks(spark, parts):
    """Fingerprints that share their low 42 bits: with so many partitions their keys go over their ends."""
    draw = random.Random(parts)
    values = sorted({draw.getrandbits(9) << 55 | 0x155555 for _ in range(300)})
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint").repartition(3)
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, tile=50).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    close = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert groups(values, found) == groups(values, close)


@pytest.mark.parametrize("segments", [6, 7, 8])
def test_links_do_not_depend_on_the_segments(spark, segments):
    draw = random.Random(11)
    values = sorted({c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(7))) for c in (draw.getrandbits(64) for _ in range(20)) for _ in range(9)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, segments=segments).collect()]
    close = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert groups(values, found) == groups(values, close)
    assert [simhash.segments_for(n) for n in (0, 10**6, 10**8, 10**9, 10**10)] == [6, 6, 6, 7, 8]


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("tile", [simhash.TILE, 70, 7])
def test_links_join_all_close_fingerprints(spark, tile):
    """Among them dense balls, whose keys are cut into tiles."""
    draw = random.Random(tile)
    values = {0, (1 << 64) - 1, 0xF, 0x1F}
    for _ in range(25):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 40])):
            values.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(9))))
    values = sorted(values)
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint").repartition(3)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(signed, tile=tile).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in found)
    close = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert groups(values, found) == groups(values, close)


def test_ring_keeps_every_close_pair_and_prunes_others():
    draw = random.Random(1)
    pick = lambda n: np.array([sum(1 << b for b in draw.sample(range(64), n)) for _ in range(3000)], np.uint64)
    for n in range(5):
        assert simhash.on_ring(pick(n), 4).all()
    assert simhash.on_ring(pick(20), 4).mean() < 0.02


def test_components(spark):
    draw = random.Random(2)
    linked = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(draw.randrange(200, 300), draw.randrange(200, 300)) for _ in range(70)]
    linked += [(7, 7), (300, 299), (299, 300), (None, 3)]
    got = components.components(spark.createDataFrame(linked, "a int, b int")).collect()
    nodes = {n for pair in linked for n in pair if n is not None}
    root = groups(nodes, [p for p in linked if None not in p])
    assert {r.node: r.root for r in got} == {n: r for n, r in root.items() if n != r}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0
