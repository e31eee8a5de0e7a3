import random
import re
from collections import Counter

from frames import AWKWARD, documents

from aislelens.llm import license_scan, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def base(text):
    words = WORD.findall((text or "").translate(A_TO_Z))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        wanted = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def found(rows):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows)


def test_base_of_all_documents(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op2_license_scan(spark, SF).collect()
    assert found(rows) == Counter((i, *base(t)) for i, t in texts)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    more = [
        (20, "mit license MIT LICENSE, mit-license"), (21, "general public licenses general public license general public"),
        (22, "Ünder the apache\x00license é mit licensé"), (23, "mit"), (24, "apache license " * 5_000), (25, "mit mit license license"),
    ]
    rows = license_scan.scan(documents(spark, AWKWARD + more, clashing=True)).collect()
    assert found(rows) == Counter((r[0], *base(r[1])) for r in AWKWARD + more)


def test_notices_survive_small_changes(spark):
    label, notice = next(n for n in license_scan.NOTICES if n[0] == "bsd")
    words = notice.split()
    docs = documents(spark, [
        (1, notice.upper()), (2, " ".join(["so", *words[:8], "also", *words[8:], "end"])), (3, " ".join(words[:9] + words[10:])),
        (4, " ".join(words[:10])), (5, " ".join(reversed(words))),
    ])
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [rows[i].labels for i in range(1, 6)] == ["bsd", "bsd", "bsd", "", ""]
    assert rows[1].score == 1 and 0.8 <= rows[3].score < 1 and rows[1].n_base == 0


def test_any_changed_word_leaves_the_other_words(spark):
    texts, wanted = [], []
    for label, notice in license_scan.NOTICES:
        words = notice.split()
        for i in range(len(words) if len(words) >= 10 else 0):
            texts.append((len(texts), " ".join([*words[:i], "zzz", *words[i + 1 :]])))
            wanted.append((label, 1 - 1 / len(words)))
    rows = sorted(license_scan.scan(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert len(wanted) > 100
    assert all(l in r.labels.split(",") and (r.n_base or abs(r.score - score) < 1e-9) for r, (l, score) in zip(rows, wanted))


def test_a_changed_word_in_running_text(spark):
    words = next(n for l, n in license_scan.NOTICES if l == "mpl").split()
    docs = documents(spark, [
        (1, " ".join([*["before"] * 40, *words[:4], "zzz", *words[5:], *["after"] * 40])),
        (2, " ".join([*["before"] * 40, *words[:2], "put", "in", *words[2:9], "zzz", *words[10:], *["after"] * 40])),
    ])
    rows = license_scan.scan(docs).collect()
    assert [(r.labels, r.score) for r in rows] == [("mpl", 13 / 14)] * 2


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for i, y in enumerate(b, 1):
            corner, row[i] = row[i], corner + 1 if x == y else max(row[i], row[i - 1])
    return row[-1]


def test_common_subsequences_by_bits():
    draw = random.Random(2)
    for _ in range(200):
        a, b = ([draw.choice([b"a", b"b", b"c", b"d"]) for _ in range(draw.randrange(1, 90))] for _ in range(2))
        assert license_scan._in_order(license_scan._wanted("x", a, 5), b) == subsequence(a, b)


def test_whole_license_texts_are_found(spark):
    """As they are, with lines wrapped and words changed; a part of one is not the whole."""
    texts = license_scan.whole_texts()
    assert len(texts) >= 11 and {"mit-text", "apache-text"} <= {label for label, _ in texts}
    draw = random.Random(5)
    rows, wanted = [], []
    for label, text in texts:
        words = text.split()
        changed = [draw.choice(["foo", w]) if draw.random() < 0.1 else w for w in words]
        around = ["prose"] * 300
        for body in (text, " ".join([*around, *words, *around]), "\n * ".join([*around, *changed])):
            rows.append((len(rows), body))
            wanted.append(label)
        if len(words) > 100:
            rows.append((len(rows), " ".join(words[: len(words) // 2])))
            wanted.append(None)
    found = sorted(license_scan.scan(documents(spark, rows)).collect(), key=lambda r: r.doc_id)
    for r, label, (_, body) in zip(found, wanted, rows):
        own = {x for x in r.labels.split(",") if x.endswith("-text")}
        assert label in r.labels.split(",") if label else not own, (label, r.labels, body[:80])


def test_large_arrow_types(spark):
    before = found(license_scan.scan(documents(spark, AWKWARD)).collect())
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", "true")
    try:
        assert found(license_scan.scan(documents(spark, AWKWARD)).collect()) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_empty_table(spark):
    assert license_scan.scan(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = documents(spark, AWKWARD)
    before = found(license_scan.scan(docs).collect())
    monkeypatch.setattr(license_scan, "MAX_BROADCAST_GRAMS", 0)
    assert found(license_scan.scan(docs).collect()) == before
