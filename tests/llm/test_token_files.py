import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from frames import AWKWARD, documents
from tokenizers import Tokenizer

from aislelens.llm import queries, token_files

SF = "/root/testdata/sf0.01"
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def plain(tokenizer, rows):
    out, start = [], 0
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def result(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_all_documents(spark, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert result(queries.op12_token_files(spark, SF)) == plain(tokenizer, rows)


def test_pieces_give_the_ids_of_the_whole_text(tokenizer):
    draw = random.Random(12)
    signs = [*"ab A'9.,!\n\t\r\x0b\x0c\x1c\x1f\x85", " ", " ", "　", "​", "᠎", "﻿", "é", "é", "字", "👩‍👩‍👧", " ", " ", "  ", "'s", "<|endoftext|>", "a", "b", "cd", "é", ".", "?", ";", "'t", "x.y", "ß", "ǆ"]
    texts = ["".join(draw.choices(signs, k=draw.randrange(40))) for _ in range(8000)] + ["", " ", "  a", "a  ", "a b", "<|endoftext|> x <|endoftext|>"]
    encoder = token_files.Encoder(open(FILE, encoding="utf-8").read(), 2)
    for text in texts:
        got = encoder.encode(text)
        assert np.frombuffer(got, encoder.kind).tolist() == ids_of(tokenizer, text), repr(text)


def test_forgetting_pieces_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_PIECES", 3)
    encoder = token_files.Encoder(open(FILE, encoding="utf-8").read(), 2)
    texts = [f"some words {i} and some more words {i}" for i in range(20)] + [None]
    assert [np.frombuffer(b, "<u2").tolist() for b in map(encoder.encode, texts)] == [ids_of(tokenizer, t) for t in texts]


def test_vocabularies_whose_texts_cannot_be_cut():
    file = public_tokenizers.path("word_bpe_49k.json")
    body, tokenizer = open(file, encoding="utf-8").read(), Tokenizer.from_file(file)
    assert token_files.can_be_cut(open(FILE, encoding="utf-8").read()) and not token_files.can_be_cut(body)
    texts = ["Some  words\nand more", " ", "", "a b\n c"]
    encoder = token_files.Encoder(body, 49407)
    wanted = [[*tokenizer.encode(t, add_special_tokens=False).ids, 49407] for t in texts]
    assert [np.frombuffer(b, encoder.kind).tolist() for b in map(encoder.encode, texts)] == wanted


def written(docs, width=2):
    out = io.BytesIO()
    writer = token_files.TokenWriter(out, width)
    for i, ids in docs:
        writer.add(i, np.array(ids, f"<u{width}").tobytes())
    writer.finish()
    return out.getvalue()


def opened(body):
    return token_files.TokenReader(pa.BufferReader(body))


@pytest.mark.parametrize("width", [2, 4])
def test_round_trip_and_random_access(monkeypatch, width):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    draw = random.Random(1)
    docs = [(i if i % 5 else None, [draw.randrange(60_000) for _ in range(draw.choice([1, 3, 9, 10, 11, 25]))]) for i in range(200)]
    body = written(docs, width)
    reader = opened(body)
    assert [int(i) if k else None for i, k in zip(reader.ids, reader.known)] == [i for i, _ in docs]
    order = list(range(len(docs)))
    draw.shuffle(order)
    for n in order:
        got = np.concatenate([*reader.read(int(reader.starts[n]), int(reader.counts[n]))])
        assert got.tolist() == docs[n][1]
    # Any zstandard reader sees the ids one after the other and skips the tables.
    everything = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).read()
    assert np.frombuffer(everything, f"<u{width}").tolist() == [x for _, ids in docs for x in ids]


def test_only_wanted_frames_are_read(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    body = bytearray(written([(i, [i] * 50) for i in range(40)]))
    reader = opened(bytes(body))
    body[int(reader.packed_from[7]) + 8] ^= 1  # damages frame 7 alone
    damaged = opened(bytes(body))
    assert np.concatenate([*damaged.read(0, 50)]).tolist() == [0] * 50
    assert np.concatenate([*damaged.read(39 * 50, 50)]).tolist() == [39] * 50
    with pytest.raises(token_files.DamagedFile):
        [*damaged.read(14 * 50, 50)]


@pytest.mark.parametrize("cut", [1, 5, 9, 30])
def test_cut_files_are_noticed(cut):
    with pytest.raises(token_files.DamagedFile):
        opened(written([(1, [1, 2, 3])])[:-cut])


def test_awkward_rows(spark, tokenizer, tmp_path):
    rows = [r[:2] for r in AWKWARD] + [(None, "same")] * 50 + [(8, None)]
    docs = documents(spark, AWKWARD + [(None, "same")] * 50 + [(8, None)], clashing=True).withColumn("task", token_files.F.lit("x"))
    index = token_files.write_tokens(docs, str(tmp_path / "files"))
    got = result(token_files.read_digests(index, str(tmp_path / "files")))
    wanted = sorted((i or 0, n, c) for i, _, n, c in plain(tokenizer, rows))
    assert sorted((i or 0, n, c) for i, _, n, c in got) == wanted
    assert [g[0] is not None for g in got] == sorted(g[0] is not None for g in got)  # rows without an id first
    ids = [g[0] for g in got if g[0] is not None]
    assert ids == sorted(ids)
    assert [g[1] for g in got] == [sum(g[2] for g in got[:n]) for n in range(len(got))]
    wanted = spark.createDataFrame([(1,), (7,), (7,), (8,), (99,)], "doc_id bigint")
    back = [(r.doc_id, list(r.ids)) for r in token_files.read_documents(index, str(tmp_path / "files"), wanted).collect()]
    assert sorted(back) == sorted((i, ids_of(tokenizer, t)) for i, t in rows if i in (1, 7, 8))


def test_folders_as_spark_names_them(tmp_path):
    for name in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        system, path = token_files.open_folder(name)
        assert path == str(tmp_path) and system.type_name == "local"


def test_empty_table(spark):
    assert token_files.token_digests(documents(spark, [(1, "a")]).limit(0)).count() == 0


def test_words_with_signs_need_no_library_rules(tokenizer, monkeypatch):
    encoder = token_files.Encoder(open(FILE, encoding="utf-8").read(), 2)
    asked, whole = [], encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda text: asked.append(text) or whole(text))
    words = ["".join(random.Random(i).choices("abcdeé", k=6)) for i in range(200)]
    texts = [f"x {w}*** {w},&&& {w}.\n{w}$$$ {w}%%%\n{w}_- {w}" for w in words]
    assert [np.frombuffer(encoder.encode(t), encoder.kind).tolist() for t in texts] == [ids_of(tokenizer, t) for t in texts]
    assert {*asked} <= {"***", ",&&&", ".", "\n", "$$$", "%%%", "_-"}


def test_runs_of_signs_give_the_ids_of_the_whole_text(tokenizer):
    draw = random.Random(5)
    signs = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " ", "\n", "a", "Bc", "é", "1", "'s", "n't", "ª", "字", "<|endoftext|>"]
    encoder = token_files.Encoder(open(FILE, encoding="utf-8").read(), 2)
    for text in ("".join(draw.choices(signs, k=draw.randrange(30))) for _ in range(6000)):
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == ids_of(tokenizer, text), repr(text)


def test_odd_spaces_are_those_of_the_pattern():
    draw = random.Random(7)
    signs = [*"ab   \n\t\r\x0b\x1c\x85", "é", "字", " ", "　", "​"]
    for text in ("".join(draw.choices(signs, k=draw.randrange(9))) for _ in range(20_000)):
        assert token_files.has_odd_space(text) == bool(token_files._ODD_SPACE.search(text)), repr(text)


@pytest.mark.parametrize("content", ["ab", "b", "7", "c..", "**"])
def test_added_tokens_within_words(content):
    rules = json.loads(open(FILE, encoding="utf-8").read())
    rules["added_tokens"].append(rules["added_tokens"][0] | {"id": 60_000, "content": content})
    body = json.dumps(rules)
    encoder, own = token_files.Encoder(body, 2), Tokenizer.from_str(body)
    assert encoder.cut
    for text in ("cab abc", "cab abc..", "ab\nabc..", "17 77", "x** c", "\nab**"):
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == ids_of(own, text), text
