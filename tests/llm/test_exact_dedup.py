import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import compare
import pytest
from frames import AWKWARD, documents

from aislelens.llm import exact_dedup, queries

SF = "/root/testdata/sf0.01"


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out.update((i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids))
    return out


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="dataset absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert compare.differences(queries.QUERIES[name](spark, SF), compare.database(SF), queries.ORACLE[name]) == []


@pytest.mark.parametrize("budget", [exact_dedup.TRIE_BYTES, 500])
def test_awkward_rows_and_spilled_tries(spark, budget):
    draw = random.Random(1)
    texts = ["a", "ab", "abc", "abd", "", " ", "a b", "a\n b", "é", " "]
    rows = AWKWARD + [(100 + i, draw.choice(texts)) for i in range(200)]
    assert found(exact_dedup.duplicates(documents(spark, rows, clashing=True), trie_bytes=budget)) == expected(rows)


def test_one_document_of_each_text_stays_whole(spark):
    docs = documents(spark, AWKWARD, clashing=True)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    owners = sorted((k[0] is None, k[0] or 0) for k, n in expected(AWKWARD).items() if k[3] for _ in range(n))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == owners


@pytest.mark.parametrize("seen", [exact_dedup.SEEN, 2])
def test_repeated_rows_stay_once(spark, monkeypatch, seen):
    monkeypatch.setattr(exact_dedup, "SEEN", seen)
    rows = [(None, "no id")] * 300 + [(7, "twice  over")] * 200 + [(8, "twice over")] * 3 + [(None, None)] * 50 + [(9, f"text {i % 5}") for i in range(100)]
    kept = Counter((r.doc_id, normal(r.text)) for r in exact_dedup.deduplicated(documents(spark, rows, clashing=True)).collect())
    assert kept == {(None, "no id"): 1, (7, "twice over"): 1, (None, ""): 1, **{(9, f"text {i}"): 1 for i in range(5)}}


def test_empty_table(spark):
    assert exact_dedup.duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_trie_is_a_map():
    draw, trie, plain = random.Random(2), exact_dedup.PatriciaTrie(), {}
    for i in range(3000):
        key = bytes(draw.choice(b"ab") for _ in range(draw.randrange(14)))
        node = trie.find(key)
        assert node.entry == plain.get(key)
        node.entry = plain[key] = i
        trie.weigh(key, 1)
    stored = {}
    while trie.held:
        stored.update(trie.spill())
    assert stored == plain
