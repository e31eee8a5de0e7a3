"""Token ids of documents in binary files: independent zstandard frames and a trailing seek table.

A file is a sequence of zstandard frames, so any zstandard tool can decompress it:

* data frames, each at most ``FRAME_IDS`` ids as little-endian unsigned numbers. A document
  that does not fit in the rest of a frame begins a new one; longer documents take several;
* a skippable frame with the directory: width of an id in bytes, then doc_id and number of ids
  of every document, compressed;
* a skippable frame with the seek table of the seekable format: compressed size,
  size and checksum (low half of XXH64) of each data frame, then number of frames, flags and a
  magic number.

A reader takes the last bytes of a file first and then only the frames that it needs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aislelens.llm.prefix import with_prefix
from aislelens.sources.files import cut_lineage, shared_folder

# Vocabulary, id after every document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
# Fixed values of the seekable format: magic numbers of the two skippable frames and of the end, flag for checksums.
DIRECTORY_MAGIC, SEEK_MAGIC, END_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Ids of a data frame, compression level, known pieces of text per process.
FRAME_IDS, LEVEL, KNOWN_PIECES = 1 << 18, 3, 500_000

INDEX = "doc_id bigint, file string, part int, first bigint, n_tokens bigint"


class DamagedFile(ValueError):
    """A frame or table that is not what the writer wrote."""


# ---- tokens --------------------------------------------------------------------------------

#: Where white space begins after another character. Words of a byte-level vocabulary hold a
#: space at most at their beginning, so none reaches over such a place and texts can be cut there.
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
#: A space at an end of the text or beside other white space; white space other than spaces and line ends (ASCII, all).
_ODD_SPACE = re.compile(r" (?:(?<=\s )|(?=\s|\Z))|\A ")
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_RARE_ASCII = [c for c in _RARE_SPACES if c.isascii()]
#: Pieces that are one word of the vocabulary's rules (Latin letters or digits; others are left to
#: its own rules), a word and then signs (no apostrophe, which may begin a word), and a line's end before these.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_SIGNS = r"[!-&(-/:;=?@\[-`{-~]"
_WORD, _SIGNS_AFTER_WORD = re.compile(f" ?(?:{_LETTERS}|[0-9]+)"), re.compile(f"( ?{_LETTERS})({_SIGNS}+)")
_WORD_OF_LINE = re.compile(f"\n{_LETTERS}{_SIGNS}*")
#: What these pieces can hold; an added token of nothing else could lie in one.
_IN_WORDS = re.compile(f"(?:{_LETTERS}|[0-9]|{_SIGNS})+")


def has_odd_space(text: str) -> bool:
    """Whether ``_ODD_SPACE`` finds something; searched by plain strings, as most texts have no other white space."""
    if any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE_SPACES)):
        return bool(_ODD_SPACE.search(text))
    return text[:1] == " " or text[-1:] == " " or "  " in text or " \n" in text or "\n " in text


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible ones as in Latin-1, the others as the letters from 256 on."""
    others = iter(range(256, 512))
    return {b: chr(b if 33 <= b <= 126 or (161 <= b <= 255 and b != 173) else next(others)) for b in range(256)}


def id_width(tokenizer: Tokenizer, end_id: int) -> int:
    return 2 if max(tokenizer.get_vocab_size(True) - 1, end_id) < 1 << 16 else 4


def can_be_cut(vocabulary: str) -> bool:
    """Whether a text's ids are those of its pieces: byte-level words, nothing changed before, no added token with white space."""
    rules = json.loads(vocabulary)
    words = rules["pre_tokenizer"] or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in rules["added_tokens"])
    return plain and not rules["normalizer"] and words.get("type") == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"]


class Pieces(dict):
    """Ids of pieces of texts as bytes, looked up once and then remembered.

    When there are ``KNOWN_PIECES``, those not met again before there are as many new ones are forgotten.
    """

    def __init__(self, find: Callable[[str], bytes]) -> None:
        self.find, self.before = find, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(piece)
        if ids is None:
            ids = self.find(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as bytes."""

    def __init__(self, vocabulary: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.width = id_width(self.tokenizer, end_id)
        self.kind = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.end = self._packed([end_id])
        self.cut = can_be_cut(vocabulary)
        self.known_words = not any(_IN_WORDS.fullmatch(t["content"]) for t in json.loads(vocabulary)["added_tokens"])
        self.letters = _byte_letters()
        self.pieces = Pieces(self._piece)
        self.after_space = Pieces(self._piece_after_space)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _word(self, written: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(written)])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _piece_after_space(self, rest: str) -> bytes:
        if self.known_words and rest.isascii() and rest.isalpha():  # letters that are written as they are
            return self._word(self.letters[32] + rest)
        return self._piece(" " + rest)

    def _piece(self, piece: str) -> bytes:
        if self.known_words:
            if _WORD.fullmatch(piece):  # no rule can split it
                return self._word(piece.encode().decode("latin-1").translate(self.letters))
            if found := _SIGNS_AFTER_WORD.fullmatch(piece):  # a word of letters ends before the signs
                word, signs = found.groups()
                return (self.after_space[word[1:]] if word[0] == " " else self.pieces[word]) + self.pieces[signs]
            if _WORD_OF_LINE.fullmatch(piece):
                return self.pieces["\n"] + self.pieces[piece[1:]]
        parts = _CUT.split(piece)
        return b"".join(map(self.pieces.__getitem__, parts)) if len(parts) > 1 else self._whole(piece)

    def encode(self, text: str | None) -> bytes:
        if not self.cut or not text:
            return self._whole(text or "") + self.end
        if has_odd_space(text):
            return b"".join([*map(self.pieces.__getitem__, _CUT.split(text)), self.end])
        first, *rest = text.split(" ")
        return b"".join([self.pieces[first], *map(self.after_space.__getitem__, rest), self.end])


def kept_encoder(name: str, vocabulary: Callable[[], str], end_id: int) -> Encoder:
    """The worker process's encoder: what it has learned serves its later tasks too."""
    kept = sys.modules.setdefault("_kept_encoders", ModuleType("_kept_encoders")).__dict__
    if (name, end_id) not in kept:
        kept[name, end_id] = Encoder(vocabulary(), end_id)
    return kept[name, end_id]


# ---- the file ------------------------------------------------------------------------------

class TokenWriter:
    """Writes one file; holds one frame and the directory."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width = out, width
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frame: list[bytes] = []
        self.room = FRAME_IDS * width
        self.seek: list[bytes] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        if len(ids) > self.room:
            self._close_frame()
        for at in range(0, len(ids), FRAME_IDS * self.width):
            part = ids[at : at + FRAME_IDS * self.width]
            if len(part) > self.room:
                self._close_frame()
            self.frame.append(part)
            self.room -= len(part)

    def _close_frame(self) -> None:
        if self.frame:
            body = b"".join(self.frame)
            packed = self.compress(body)
            self.seek.append(struct.pack("<III", len(packed), len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF))
            self.out.write(packed)
        self.frame, self.room = [], FRAME_IDS * self.width

    def finish(self) -> None:
        self._close_frame()
        known = np.array([i is not None for i in self.ids], np.uint8)
        directory = self.compress(b"".join([
            struct.pack("<BQ", self.width, len(self.ids)), known.tobytes(),
            np.array([i or 0 for i in self.ids], "<i8").tobytes(), np.array(self.counts, "<i8").tobytes(),
        ]))
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenReader:
    """Random access to one file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or flags != CHECKSUMS:
            raise DamagedFile("no seek table at the end")
        length = 12 * frames + 9
        head, table = self._at(size - length - 8, 8), self._at(size - length, length - 9)
        if struct.unpack("<II", head) != (SEEK_MAGIC, length):
            raise DamagedFile("the seek table has another length")
        self.frames = np.frombuffer(table, "<u4").reshape(-1, 3).astype(np.int64)
        self.packed_from = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.from_byte = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        at = int(self.packed_from[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != DIRECTORY_MAGIC or at + 8 + length != size - 8 - 12 * frames - 9:
            raise DamagedFile("no directory")
        directory = self._decompressed(self._at(at + 8, length))
        self.width, n = struct.unpack_from("<BQ", directory)
        if len(directory) != 9 + 17 * n:
            raise DamagedFile("the directory has another length")
        self.known = np.frombuffer(directory, np.uint8, n, 9).astype(bool)
        self.ids = np.frombuffer(directory, "<i8", n, 9 + n)
        self.counts = np.frombuffer(directory, "<i8", n, 9 + 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.held: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, length: int) -> bytes:
        if at < 0:
            raise DamagedFile("the file is too short")
        self.source.seek(at)
        return self.source.read(length)

    @staticmethod
    def _decompressed(packed: bytes) -> bytes:
        try:
            return zstandard.ZstdDecompressor().decompress(packed)
        except zstandard.ZstdError as error:
            raise DamagedFile(str(error)) from error

    def frame(self, number: int) -> bytes:
        """The bytes of one frame, checked; the last one read is kept."""
        if self.held[0] != number:
            packed, length, checksum = self.frames[number]
            body = self._decompressed(self._at(int(self.packed_from[number]), int(packed)))
            if len(body) != length or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != checksum:
                raise DamagedFile(f"checksum of frame {number}")
            self.held = number, body
        return self.held[1]

    def read(self, first: int, count: int) -> Iterator[np.ndarray]:
        """``count`` ids from the place ``first`` of the file, a frame at a time."""
        low, high = first * self.width, (first + count) * self.width
        number = int(np.searchsorted(self.from_byte, low, "right")) - 1
        while low < high:
            begin, end = int(self.from_byte[number]), int(self.from_byte[number + 1])
            yield np.frombuffer(self.frame(number), f"<u{self.width}")[(low - begin) // self.width : (min(high, end) - begin) // self.width]
            low, number = end, number + 1


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and the folder's path there."""
    if folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:").removeprefix("//")
    elif "://" not in folder:
        folder = f"file://{os.path.abspath(folder)}"
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


# ---- Spark -----------------------------------------------------------------------------------

def _written(folder: str, vocabulary, name_of_vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = f"part-{part:06}-{uuid.uuid4().hex}.tokens"  # an attempt that is lost leaves a file that no index names
        encoder, writer, out = None, None, None
        first = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, path = open_folder(folder)
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}")
                encoder = kept_encoder(name_of_vocabulary, lambda: vocabulary.value, end_id)
                writer = TokenWriter(out, encoder.width)
            counts = np.empty(batch.num_rows, np.int64)
            for i, (doc_id, ids) in enumerate(zip(batch.column(0).to_pylist(), (encoder.encode(t.as_py()) for t in batch.column(1)))):
                writer.add(doc_id, ids)
                counts[i] = len(ids) // encoder.width
            starts = first + np.cumsum(counts) - counts
            first += int(counts.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([name] * batch.num_rows), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(starts), pa.array(counts),
            ], names=["doc_id", "file", "part", "first", "n_tokens"])
        if writer is not None:
            writer.finish()
            out.close()

    return write


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode whole texts and write them to files in ``folder``, in ascending order of doc_id.

    Returns the index: doc_id, file, part (files ascend by it), first (place of the document's
    first id in its file), n_tokens (with the end id). ``tokenizer`` is the file of the
    vocabulary. Null text counts as empty and has the end id alone; rows without an id come
    first, repeated rows are separate, equal ids are ordered by a hash of their text.

    Texts are range-partitioned by id, then text, then input task, so no id holds a task up. A
    file is written by one attempt of a task under a name of its own, and the index, written by
    Spark, names the files of the attempts that were kept.
    """
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        rules = file.read()
    vocabulary, name = spark.sparkContext.broadcast(rules), hashlib.sha256(rules.encode()).hexdigest()  # a few MB
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "task": F.spark_partition_id()})
    dealt = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "hash", "task").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash")
    return cut_lineage(dealt.select("doc_id", "text").mapInArrow(_written(folder, vocabulary, name, end_id), INDEX))


def _places(index: DataFrame) -> DataFrame:
    """Files with the number of ids in all files before them."""
    files = index.groupBy("file", "part").agg(F.sum("n_tokens").alias("ids"))
    sliced = files.withColumns({"whole": F.lit(1), "slice": F.floor(F.col("part") / 1000)})
    return with_prefix(sliced, ["whole"], ["slice"], ["part"], {"before": "ids"}).select("file", "part", "before")


def _digests(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(f"{path}/{name}") as source:
                    reader = TokenReader(source)
                    checks = np.empty(len(reader.ids), np.int64)
                    for i, (first, count) in enumerate(zip(reader.starts.tolist(), reader.counts.tolist())):
                        check = 0
                        for ids in reader.read(first, count):
                            check = zlib.crc32(ids.astype("<u4"), check)
                        checks[i] = check
                    yield pa.RecordBatch.from_arrays([
                        pa.array(reader.ids, mask=~reader.known), pa.array(reader.starts[:-1] + before), pa.array(reader.counts), pa.array(checks),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """Every document as the files hold it: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are read one to a task where there are enough tasks, a frame at a time.
    """
    files = cut_lineage(_places(index))
    dealt = files.repartitionByRange(max(1, files.count()), "part").select("file", "before")
    return dealt.mapInArrow(_digests(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _fetched(folder: str):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        source, reader, current = None, None, None
        for batch in batches:
            for doc_id, name, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                if name != current:
                    if source is not None:
                        source.close()
                    source = system.open_input_file(f"{path}/{name}")
                    reader, current = TokenReader(source), name
                ids = np.concatenate([*reader.read(first, count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["doc_id", "ids"]
                )
        if source is not None:
            source.close()

    return fetch


def read_documents(index: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The ids of the documents named in ``wanted`` (doc_id): doc_id, ids.

    Only the frames that hold them are read and decompressed; a frame is read once for
    neighbouring documents. Repeated ids in the index give a row each, unknown ids none.
    """
    own = index.join(wanted.select("doc_id").distinct(), "doc_id").select("doc_id", "file", "first", "n_tokens")
    dealt = own.repartition("file").sortWithinPartitions("file", "first")
    return dealt.mapInArrow(_fetched(folder), "doc_id bigint, ids array<int>")


def token_digests(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the documents' ids to files, read the files back and return what they hold."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_digests(write_tokens(docs, folder, **options), folder)
