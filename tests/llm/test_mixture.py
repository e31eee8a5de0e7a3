import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from frames import AWKWARD, documents

from aislelens.llm import mixture, prefix


def plain_targets(sizes, volume=Fraction(3, 2)):
    """Share by weight; what a full source cannot take is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixture.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = volume * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_by_resharing(spark):
    draw = random.Random(4)
    for _ in range(3):
        sizes = {s: draw.randrange(1, 10 ** draw.randrange(1, 6)) for s in ["", "a", "B", "é", "zz", "z", "💡", "m", "n", None]}
        got = mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        wanted = plain_targets(sizes)
        assert all(abs(r.target - wanted[r.source]) < 1e-6 * max(1, r.target) for r in got)


def test_quotas_by_highest_quotients(spark):
    draw = random.Random(9)
    for block in (1, 16, 1000):
        rows = [(i, draw.randrange(1, 5000)) for i in range(23)]
        aimed = [(i, size, float(draw.randrange(0, 2 * size))) for i, size in rows]
        got = mixture.quotas(spark.createDataFrame(aimed, "rank int, source_size bigint, target double"), block=block).collect()
        seats, won = int(sum(t for _, _, t in aimed) / block + 0.5), Counter()
        for _ in range(seats):
            best = max(aimed, key=lambda a: (a[2] / (2 * won[a[0]] + 1), -a[0]))
            won[best[0]] += 1
        assert {r.rank: r.quota for r in got} == {i: min(won[i], 2 * -(-size // block)) for i, size, _ in aimed}


def check(rows, docs):
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.taken == r.uses * r.size + r.n_words and 0 <= r.taken <= 2 * r.size
        assert r.n_words == 0 or (0 <= r.from_word < r.size and r.n_words < r.size)
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in docs)
    assert all(abs(taken[s] - target[s]) <= 2 * mixture.BLOCK for s in taken)
    assert all(r.source_size == size[r.source] for r in rows)
    cut = Counter(r.source for r in rows if r.n_words)
    assert max(cut.values(), default=0) <= 2
    return taken


def test_mixture_of_a_hot_source(spark):
    draw = random.Random(7)
    docs = [(i, "w " * draw.randrange(0, 300), None, draw.choice(["a", "a", "a", "b", "c", None, f"s{i % 5}"])) for i in range(400)]
    rows = mixture.mix(documents(spark, docs, clashing=True)).collect()
    check(rows, docs)
    again = mixture.mix(documents(spark, docs).repartition(7)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    assert {r.shard for r in rows if r.taken} == set(range(mixture.SHARDS)) and all((r.shard is None) == (r.taken == 0) for r in rows)


def test_awkward_rows(spark):
    check(mixture.mix(documents(spark, AWKWARD, clashing=True)).collect(), AWKWARD)


def test_texts_of_the_mixture(spark):
    docs = [(i, " ".join(f"w{i}.{k}" for k in range(i % 90)) + "\n", None, "ab"[i % 2]) for i in range(150)] + [(3, " ".join(f"w3.{k}" for k in range(3)) + "\n", None, "b")]
    plan = mixture.mix(documents(spark, docs)).collect()
    frame = documents(spark, docs, clashing=True)
    mixed = mixture.mixed(frame)
    assert mixed.columns == frame.columns
    words = defaultdict(int)
    for r in mixed.collect():
        own = re.findall(prefix.WORD, r.text)
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and [w.split(".")[0] for w in own] == [f"w{r.doc_id}"] * len(own)
        first = int(own[0].split(".")[1])
        assert [int(w.split(".")[1]) for w in own] == [(first + k) % (r.doc_id % 90) for k in range(len(own))]
    wanted = Counter()
    for r in plan:
        wanted[r.doc_id] += r.taken
    assert dict(words) == {i: n for i, n in wanted.items() if n}


def test_empty_table(spark):
    empty = documents(spark, [(1, "a")]).limit(0)
    assert mixture.mix(empty).count() == 0 and mixture.mixed(empty).count() == 0


def test_rows_without_id_spread_over_slices(spark):
    docs = [(None, f"text {i} of many", None, "a") for i in range(300)] + [(i, "w " * 5, None, "b") for i in range(30)]
    frame = documents(spark, docs)
    places = frame.filter("doc_id is null").select(prefix.seeded_order(1, prefix.row_identity()).alias("o"))
    assert places.distinct().count() == 300
    check(mixture.mix(frame).collect(), docs)


def test_repeated_ids_and_a_third_of_rows_without_id(spark):
    """Every row is used as often as the plan says for its id (or text) and size; nothing is joined with its like."""
    draw = random.Random(3)
    docs = [(None, f"word {i} " + "x " * 8, None, "a") for i in range(200)] + [(i % 40, f"own {i} " + "y " * 8, None, "a") for i in range(200)]
    docs += [(i, "z " * draw.randrange(1, 200), None, "bc"[i % 2]) for i in range(1000, 1200)] + [(7, "same text", None, "b")] * 50
    frame = documents(spark, docs)
    found = mixture.mixed(frame)
    plan = mixture.mix(frame).collect()
    words = Counter()
    for r in found.collect():
        words[r.doc_id, r.source] += len(r.text.split())
    wanted = Counter()
    for r in plan:
        wanted[r.doc_id, r.source] += r.taken
    assert words == Counter({k: n for k, n in wanted.items() if n})
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, mixture.mixed(frame.repartition(7)).collect()), key=str)
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    assert "abs(" not in plan_text and "NestedLoop" not in plan_text and "Cartesian" not in plan_text


def test_prefix_sums(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), f"{draw.randrange(16**6):06x}", draw.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, o string, v bigint").withColumns(prefix.seeded_slices("o"))
    got = prefix.with_prefix(df, ["g"], ["slice", "coarse"], ["o", "v"], {"before": "v"}).collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: (r.o, r.v)):
            assert r.before == total
            total += r.v
