"""Language identification by compression.

Every language gets a raw-content zstandard dictionary filled from sample documents. A text
belongs to the language whose dictionary makes it smallest; a narrow win is no decision.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"

#: Bounds of what is learned: documents per language, and bytes of each dictionary.
SAMPLE_DOCS, DICTIONARY_BYTES = 64, 65_536
#: Texts are compressed in blocks of this many bytes, so that the dictionary and not the
#: text's own beginning explains each of them. All blocks of a text count.
BLOCK_BYTES, LEVEL = 4_096, 5
#: The second-best size must exceed the best by this share of it, or the text is rejected.
MIN_MARGIN = 0.005

PREDICTION = "lang_pred string, score double, margin double, rejected boolean"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> str:
    """Lower-case words, padded and separated by one space; empty without a letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} " if any(map(str.isalpha, words)) else ""


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries in the order in which ties are decided."""

    dictionaries: dict[str, bytes]


def train(
    docs: DataFrame, *, text: str = "text", lang: str = "lang",
    sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> LanguageModel:
    """Dictionaries from at most ``sample_docs`` different documents of every language.

    Rows without text or language teach nothing; a repeated text counts once. The sample is
    the documents with the smallest content hashes, so reruns agree; however often texts are
    copied, the sample is full if the language has so many different ones. No document teaches more
    than ``dictionary_bytes`` characters, so what reaches the driver is bounded however long
    texts are. Ties in size later go to the language with more labelled rows, then by name.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    keyed = labelled.withColumn("key", F.xxhash64("text"))
    parts = keyed.select("lang", "key").mapInPandas(_smallest(sample_docs), "lang string, n bigint, keys array<bigint>")
    keys = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))), 1, sample_docs)
    found = parts.groupBy("lang").agg(F.sum("n").alias("n"), keys.alias("keys")).collect()
    counts = {r.lang: r.n for r in found}
    if not counts:
        return LanguageModel({})
    wanted = docs.sparkSession.createDataFrame([(r.lang, k) for r in found for k in r["keys"]], "lang string, key bigint")
    sample = (
        keyed.join(F.broadcast(wanted), ["lang", "key"])
        .groupBy("lang", "key")
        .agg(F.min(F.substring("text", 1, dictionary_bytes)).alias("text"))
        .collect()
    )
    pieces: dict[str, list[str]] = {l: [] for l in sorted(counts, key=lambda l: (-counts[l], l))}
    for row in sorted(sample, key=lambda r: (r.lang, r.key)):
        if words := normalise(row.text):
            pieces[row.lang].append(words)
    return LanguageModel({l: _dictionary(p, dictionary_bytes) for l, p in pieces.items() if p})


def _smallest(size: int):
    """Of each task: every language's rows and its ``size`` smallest different hashes."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: dict[str, int] = {}
        smallest: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, keys in batch.groupby("lang")["key"]:
                rows[lang] = rows.get(lang, 0) + len(keys)
                smallest[lang] = np.unique(np.append(smallest.get(lang, np.zeros(0, np.int64)), keys.to_numpy()))[:size]
        if rows:
            yield pd.DataFrame({"lang": list(rows), "n": list(rows.values()), "keys": [smallest[l] for l in rows]})

    return scan


def _dictionary(texts: list[str], size: int) -> bytes:
    """An equal share of every text; what short ones leave goes to the others."""
    encoded = sorted((t.encode() for t in texts), key=len)
    out, left = [], size
    for i, t in enumerate(encoded):
        out.append(t[: left // (len(encoded) - i)])
        left -= len(out[-1])
    return b"".join(out)


def _compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, content in dictionaries.items():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        out[lang] = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
        )
    return out


def _decide(text: str | None, compressors: dict, min_margin: float) -> tuple[str, float, float, bool]:
    data = normalise(text).encode() if text else b""
    if not data or not compressors:
        return UNDETERMINED, 0.0, 0.0, True
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = [(sum(len(c.compress(b)) for b in blocks), i, l) for i, (l, c) in enumerate(compressors.items())]
    best, _, lang = min(sizes)
    score = 1.0 / sum(2.0 ** -min(1000, size - best) for size, _, _ in sizes)
    if len(sizes) == 1:
        return lang, score, 1.0, False
    margin = (sorted(sizes)[1][0] - best) / best
    return lang, score, margin, margin < min_margin


def predict(spark, model: LanguageModel, text: Column, min_margin: float = MIN_MARGIN) -> Column:
    """A struct of ``PREDICTION``; it sees nothing but the text.

    ``und`` with score 0 for a text that is null or has no letter, or when nothing was
    learned. ``score`` weighs each language by 2 to the power of minus its size in bytes.
    ``rejected`` is true for ``und`` and for a margin below ``min_margin``.
    """
    shared = spark.sparkContext.broadcast(model.dictionaries)

    @F.pandas_udf(PREDICTION)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(shared.value)
        for texts in batches:
            rows = [_decide(t, compressors, min_margin) for t in texts]
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])

    return classify(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are kept from learning: a third, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out.

    One row per input row: doc_id, held_out, lang_pred, score, margin, rejected. A row
    without an id is not held out.
    """
    model = train(docs.filter(~held_out()))
    found = docs.select(
        "doc_id", held_out().alias("held_out"), predict(docs.sparkSession, model, F.col("text")).alias("_p")
    )
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.margin", "_p.rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, unchanged, whose language is beyond doubt."""
    model = train(docs.filter(~held_out()))
    return docs.filter(~predict(docs.sparkSession, model, F.col("text"))["rejected"])
