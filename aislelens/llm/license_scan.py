"""License notices by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the positions of the same
grams in the license templates. Matches of one copied passage lie on one diagonal (document
position minus template position): votes are counted per diagonal, diagonals next to each
other are merged, and the words of each merged span are compared with the template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases that name a license, and the wording of well-known notices.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("cc", "licensed under cc by nc"),
    ("cc", "licensed under cc by sa"),
    ("cc", "licensed under cc by nd"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Whole texts of licenses, with their public origin.
TEXTS_FILE = Path(__file__).with_name("licenses.txt")

#: Words in a gram: phrases are found by pairs, notices by five words.
PHRASE_GRAM, NOTICE_GRAM = 2, 5
#: Diagonals of one notice that are at most so far apart belong together (words left out or put in).
SLACK = 4
#: Share of a notice's words that a span must hold.
MIN_COVER = 0.8
#: Template grams that may be broadcast; a larger collection is joined by a shuffle.
MAX_BROADCAST_GRAMS = 1_000_000
#: Bytes of text hashed at a time.
CHUNK_BYTES = 4_000_000

_END = 0  # the hash of the one mark that each document adds behind its grams
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

SCANNED = "uid bigint, doc_id bigint, n_words bigint, body binary, grams array<bigint>"
FOUND = "n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


# ---- rolling hashes ------------------------------------------------------------------

def _word_hashes(lowered: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte position of every word; ``starts`` are the positions where texts begin."""
    inside = _IN_WORD[lowered]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[starts] = inside[starts]
    at = np.nonzero(inside)[0]
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.nonzero(opens[at])[0]
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(lengths.max(), _BASE, np.uint64))
    sums = np.add.reduceat((lowered[at].astype(np.uint64) + np.uint64(1)) * powers[place], first)
    return sums ^ (sums >> np.uint64(29)), at[first]


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from every position on."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * _MIX
        out ^= out >> np.uint64(32)
    return out


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) at a time: their lower-cased bytes and where each text begins in them."""
    column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, j, _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        i = j


def whole_texts(file: Path = TEXTS_FILE) -> list[tuple[str, str]]:
    """(label, text) of every license in a file: lines beginning with ``== `` name them."""
    _, *parts = re.split(r"^== (\S+).*$", file.read_text(encoding="utf-8"), flags=re.M)
    return list(zip(parts[::2], parts[1::2]))


def _rolling(known: np.ndarray):
    """Every document's pair hashes, five-word hashes and end mark; the text goes along if a gram is ``known``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, lowered, bounds in _text_chunks(batch.column(1)):
                filled = bounds[:-1][np.diff(bounds) > 0]
                hashes, at = _word_hashes(lowered, filled)
                edges = np.searchsorted(at, bounds)
                grams, bodies = [], []
                for d in range(j - i):
                    words = hashes[edges[d] : edges[d + 1]]
                    own = np.concatenate([_grams(words, PHRASE_GRAM), _grams(words, NOTICE_GRAM)])
                    hit = len(known) and (known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own).any()
                    bodies.append(lowered[bounds[d] : bounds[d + 1]].tobytes() if hit else None)
                    grams += [own, np.array([_END], np.uint64)]
                sizes = [0, *(len(a) + 1 for a in grams[::2])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(uid, uid + j - i)),
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(edges)),
                    pa.array(bodies, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(grams).view(np.int64))),
                ], names=["uid", "doc_id", "n_words", "body", "grams"])
                uid += j - i

    return scan


# ---- templates -----------------------------------------------------------------------

def _templates(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple[str, list[bytes], int]]:
    """(label, words, words in a gram) of every phrase, then of every notice."""
    texts = [(label, text, PHRASE_GRAM) for text, label in phrases.items()] + [(l, t, NOTICE_GRAM) for l, t in notices]
    out = [(label, _WORD.findall(text.encode().lower()), k) for label, text, k in texts]
    if short := [label for label, words, k in out if len(words) < k]:
        raise ValueError(f"templates shorter than their grams: {short}")
    return out


def _template_grams(templates: list) -> list[tuple[int, int, int]]:
    """(gram hash, template, position), and the end mark as template -1."""
    out = [(_END, -1, 0)]
    for t, (_, words, k) in enumerate(templates):
        text = np.frombuffer(b" ".join(words), np.uint8)
        hashes, _ = _word_hashes(text, np.array([0]))
        out += [(int(g), t, i) for i, g in enumerate(_grams(hashes, k).view(np.int64))]
    return out


# ---- verification --------------------------------------------------------------------

class Wanted(NamedTuple):
    """A template ready to be compared: its words, each with the places where it stands as bits."""

    label: str
    words: list[bytes]
    gram: int
    counts: Counter
    places: dict[bytes, int]


def _wanted(label: str, words: list[bytes], gram: int) -> Wanted:
    places: dict[bytes, int] = {}
    for i, word in enumerate(words):
        places[word] = places.get(word, 0) | 1 << i
    return Wanted(label, words, gram, Counter(words), places)


def _verify(body: bytes | None, spans: list, templates: list[Wanted], slack: int) -> tuple:
    """Compare every span's words with its template; count the base places.

    ``low`` and ``high`` are the first and last diagonal, where the template would begin. All
    its words are looked for from there on, also those outside the matching grams.
    """
    if body is None or not len(spans):
        return 0, None, None, "", "", 0.0
    words = _WORD.findall(body)
    n, first, last, base, labels, score = 0, None, None, set(), set(), 0.0
    for span in spans:
        template = templates[span["template"]]
        low, high, size = span["low"], span["high"], len(template.words)
        if template.gram == PHRASE_GRAM:
            if words[low : low + size] == template.words:
                n, first, last = n + 1, min(low, low if first is None else first), max(low, low if last is None else last)
                base.add(template.label)
                score = 1.0
            continue
        near = words[max(0, low - slack) : high + size + slack]
        if (Counter(near) & template.counts).total() < MIN_COVER * size:
            continue  # too few of its words, in whatever order
        cover = _in_order(template, near) / size
        if cover >= MIN_COVER:
            labels.add(template.label)
            score = max(score, cover)
    return n, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def _in_order(template: Wanted, words: list[bytes]) -> int:
    """Length of the longest common subsequence; a bit for each word of the template, all at once."""
    everything = (1 << len(template.words)) - 1
    open_places = everything
    for word in words:
        if hits := open_places & template.places.get(word, 0):
            open_places = ((open_places + hits) | (open_places - hits)) & everything
    return len(template.words) - open_places.bit_count()


def scan(
    docs: DataFrame, *, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] | None = None, slack: int = SLACK,
) -> DataFrame:
    """License mentions of every document, one row per input row.

    Columns: doc_id, n_words, n_base (places where a phrase stands), first_word, last_word
    (their smallest and largest start), base_labels, labels (phrases and notices; sorted,
    comma-joined), score (share of the best match's words, 0 without one). Null text is
    empty; repeated rows are separate documents. ``notices`` are ``NOTICES`` and the whole
    license texts of ``TEXTS_FILE`` unless given; a text or notice counts if a span holds
    ``MIN_COVER`` of its words in their order.
    """
    spark: SparkSession = docs.sparkSession
    templates = _templates(phrases, [*NOTICES, *whole_texts()] if notices is None else notices)
    wanted = [_wanted(*t) for t in templates]
    rows = _template_grams(templates)
    known = np.unique(np.array([r[0] for r in rows[1:]], np.int64).view(np.uint64))
    grams = spark.createDataFrame(rows, "gram bigint, template int, place int")
    if len(rows) <= MAX_BROADCAST_GRAMS:
        grams = F.broadcast(grams)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    scanned = texts.mapInArrow(_rolling(known), SCANNED)
    places = scanned.select("uid", "doc_id", "n_words", "body", F.posexplode("grams").alias("at", "gram"))
    end = F.col("template") < 0
    of_phrase = F.col("template") < len(phrases)
    start = F.when(of_phrase, F.col("at")).otherwise(F.col("at") - F.greatest(F.col("n_words") - (PHRASE_GRAM - 1), F.lit(0)))
    hits = places.join(grams, "gram").select(
        "uid", "doc_id", "n_words", F.when(end, F.col("body")).alias("body"), "template",
        F.when(end, 0).otherwise(start - F.col("place")).alias("diagonal"),
    )

    votes = hits.groupBy("uid", "template", "diagonal").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("body").alias("body"),
        F.count("*").alias("votes"),
    )
    by_diagonal = Window.partitionBy("uid", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    apart = (step > F.when(of_phrase, 0).otherwise(slack)).cast("int")
    merged = (
        votes.withColumn("apart", F.coalesce(apart, F.lit(0)))
        .withColumn("island", F.sum("apart").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("uid", "template", "island")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("body").alias("body"),
            F.min("diagonal").alias("low"), F.max("diagonal").alias("high"),
        )
    )
    span = F.when(~end, F.struct("template", "low", "high"))
    per_doc = merged.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("body").alias("body"), F.collect_list(span).alias("spans")
    )

    @F.pandas_udf(FOUND)
    def verified(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
        found = [_verify(b, s, wanted, slack) for b, s in zip(bodies, spans)]
        out = pd.DataFrame(found, columns=["n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    out = per_doc.select("doc_id", "n_words", verified("body", "spans").alias("_f"))
    return out.select("doc_id", "n_words", "_f.*")
