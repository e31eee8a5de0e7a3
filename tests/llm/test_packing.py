import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from frames import AWKWARD, documents

from aislelens.llm import packing, queries

SF = "/root/testdata/sf0.01"


def padding(histogram, bounds):
    return sum(n * (min(b for b in bounds if b >= l) - l) for l, n in histogram.items() if l > 0)


def test_bounds_are_optimal():
    draw = random.Random(6)
    for _ in range(60):
        histogram = {draw.randrange(1, 40): draw.randrange(1, 30) for _ in range(draw.randrange(1, 9))}
        for buckets in (1, 2, 3, 20):
            bounds = packing.bucket_bounds(histogram, buckets)
            lengths = sorted(histogram)
            assert bounds == sorted(set(bounds)) and len(bounds) <= buckets and bounds[-1] == lengths[-1]
            ways = [[*c, lengths[-1]] for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k)]
            assert padding(histogram, bounds) == min(padding(histogram, w) for w in ways)
    assert packing.bucket_bounds({}, 4) == [] and packing.bucket_bounds({0: 5}, 4) == []


def check(rows, docs, max_words, batch_words):
    """Every word is in one piece; batches are full, of one bucket and within the budget."""
    words = Counter()
    for i, t in docs:
        n = len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        words.update((i, p, p * max_words, min(max_words, n - p * max_words)) for p in range(max(1, -(-n // max_words))))
    assert Counter((r.doc_id, r.piece, r.first_word, r.n_words) for r in rows) == words
    batches = defaultdict(list)
    for r in rows:
        assert (r.batch is None) == (r.bucket is None) == (r.n_words == 0)
        if r.batch is not None:
            assert r.n_words <= r.bucket_words
            batches[r.batch].append(r)
    assert sorted(batches) == list(range(len(batches)))
    short = Counter()
    for own in batches.values():
        room = max(1, batch_words // own[0].bucket_words)
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= room
        short[own[0].bucket] += len(own) < room
    assert all(n <= 1 for n in short.values())
    histogram = Counter(r.n_words for r in rows)
    assert sorted({r.bucket_words for r in rows if r.bucket is not None}) == packing.bucket_bounds(histogram, packing.BUCKETS)


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(queries.op8_packing(spark, SF).collect(), docs, packing.MAX_WORDS, packing.BATCH_WORDS)


def test_awkward_rows(spark):
    docs = [r[:2] for r in AWKWARD]
    check(packing.pack(documents(spark, AWKWARD, clashing=True), max_words=7, batch_words=20).collect(), docs, 7, 20)


def test_reruns_agree_and_empty_table(spark):
    docs = documents(spark, [(i, "w " * (i % 30)) for i in range(300)])
    assert sorted(packing.pack(docs).collect()) == sorted(packing.pack(docs.repartition(5)).collect())
    assert packing.pack(docs.limit(0)).count() == 0
