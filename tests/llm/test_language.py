import zlib

import pytest
import zstandard
from frames import AWKWARD, documents

from aislelens.llm import language, queries

SF = "/root/testdata/sf0.01"
WORDS = {"en": "the house and the garden of our friends with many old trees", "de": "das haus und der garten unserer freunde mit vielen alten bäumen"}


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.97 * len(tested)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


@pytest.fixture(scope="module")
def rows(spark):
    known = [(100 + i, WORDS[l] + f" {i}", l) for i, l in enumerate(["en", "de"] * 12)]
    return {r.doc_id: r for r in language.identify(documents(spark, AWKWARD + known, clashing=True)).collect()}


def test_undetermined_without_letters(rows):
    assert {i: (rows[i].lang_pred, rows[i].score, rows[i].rejected) for i in (3, 4, 5, 9)} == dict.fromkeys((3, 4, 5, 9), ("und", 0.0, True))


def test_learned_values_only(rows):
    assert {r.lang_pred for r in rows.values()} <= {"und", "en", "de", "fr"}
    assert all(rows[100 + i].lang_pred == l for i, l in enumerate(["en", "de"] * 12))


def test_nothing_learned_from_held_out_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = documents(spark, [(i, WORDS["de"], "xx") for i in held] + [(1000, WORDS["en"], "en")])
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"en"}


def test_empty_and_unlabelled_tables(spark):
    assert language.identify(documents(spark, [(1, "a")]).limit(0)).count() == 0
    assert [r.lang_pred for r in language.identify(documents(spark, [(1, "some text")])).collect()] == ["und"]


def test_decisions_by_plain_compression(spark):
    """Sizes by an independent loop over one small model: smallest wins, narrow margins are rejected."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(frame.filter(~language.held_out()), dictionary_bytes=4_000)
    rows = frame.select("text", language.predict(spark, model, language.F.col("text")).alias("p")).collect()

    def size(words, content):
        total = 0
        for i in range(0, len(words), language.BLOCK_BYTES):
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plain = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(plain.compress(words[i : i + language.BLOCK_BYTES]))
        return total

    for r in rows[::7]:
        words = language.normalise(r.text).encode() if r.text else b""
        if not words:
            assert (r.p.lang_pred, r.p.rejected) == ("und", True)
            continue
        sizes = {l: size(words, c) for l, c in model.dictionaries.items()}
        first, second = sorted(sizes.values())[:2]
        assert sizes[r.p.lang_pred] == first and r.p.margin == pytest.approx((second - first) / first)
        assert r.p.rejected == ((second - first) / first < language.MIN_MARGIN)


def test_equal_dictionaries_are_rejected(spark):
    docs = documents(spark, [(i, WORDS["en"], ("en", "fr")[i % 2]) for i in range(30)])
    assert all(r.rejected and r.margin == 0 for r in language.identify(docs).collect())
    assert language.accepted(docs).count() == 0


def test_a_long_document_teaches_a_bounded_part(spark):
    docs = documents(spark, [(i, (WORDS["en"] + " ") * 5_000, "en") for i in range(5)] + [(100 + i, WORDS["de"], "de") for i in range(5)])
    model = language.train(docs, dictionary_bytes=1_000)
    assert set(model.dictionaries) == {"en", "de"} and all(0 < len(d) <= 1_000 for d in model.dictionaries.values())


def test_copies_leave_the_sample_whole(spark):
    texts = [f"{WORDS['de']} {chr(97 + i)}{chr(110 + j)}" for i in range(10) for j in range(10)]
    copies = spark.range(400_000).selectExpr("id as doc_id", "'immer wieder der gleiche text' as text", "'de' as lang")
    docs = copies.union(spark.createDataFrame([(i, t, "de") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"))
    few = docs.dropDuplicates(["text"])
    model = language.train(docs)
    assert model == language.train(few) and sum(language.normalise(t).encode() in model.dictionaries["de"] for t in texts) >= 63
