"""Packing texts into batches from optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislelens.llm.prefix import row_identity, seeded_order, seeded_slices, with_prefix, word_count
from aislelens.sources.files import cut_lineage

#: Longest piece in words, words in a batch with padding, buckets, seed of the order.
MAX_WORDS, BATCH_WORDS, BUCKETS, SEED = 2_048, 16_384, 16, 42


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets that pad the fewest words in all.

    Dynamic programming over the lengths that occur: the cheapest way to put the first j
    lengths into k buckets ends with a bucket from some length i + 1 to j, all padded to
    length j. Equal costs take the longer last bucket.
    """
    lengths = sorted(l for l, n in histogram.items() if l > 0 and n > 0)
    if not lengths:
        return []
    size = np.array(lengths, dtype=float)
    below = np.concatenate([[0.0], np.cumsum([float(histogram[l]) for l in lengths])])
    n = len(lengths)
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, n)):
        now, cut = np.concatenate([[0.0], np.empty(n)]), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            ways = cost[:j] + size[j - 1] * (below[j] - below[:j])
            cut[j] = int(np.argmin(ways))
            now[j] = ways[cut[j]]
        cost = now
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(lengths[j - 1])
        j = int(cut[j])
    return bounds[::-1]


def _batches_before(histogram: dict[int, int], bounds: list[int], batch_words: int) -> list[int]:
    """For every bucket the batches of the buckets before it, and those of all."""
    before, low = [0], 0
    for bound in bounds:
        pieces = sum(n for l, n in histogram.items() if low < l <= bound)
        before.append(before[-1] - (-pieces // max(1, batch_words // bound)))
        low = bound
    return before


def pack(
    docs: DataFrame, *, max_words: int = MAX_WORDS, batch_words: int = BATCH_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Batches of similar lengths; every word of every row is in exactly one piece.

    Columns: doc_id, piece (0, 1, ...; a text over ``max_words`` words is cut into pieces of
    that length and a rest), first_word, n_words, bucket, bucket_words (the length that its
    pieces are padded to), batch (unique over all buckets), slot (0, 1, ... in the batch).
    A batch holds as many pieces as fit ``batch_words`` with padding, one at least; only the
    last batch of a bucket may hold fewer. Pieces come in a seeded order. A text without words
    (or null) is one piece of 0 words without bucket and batch. Repeated rows are separate.

    The histogram over all rows has at most ``max_words`` entries; it alone reaches the driver.
    """
    words = docs.select("doc_id", row_identity().alias("identity"), word_count("text").alias("words"))
    last = F.floor(F.greatest(F.col("words") - 1, F.lit(0)) / max_words)
    pieces = words.select("doc_id", "identity", "words", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = pieces.withColumn("first_word", F.col("piece") * max_words)
    pieces = pieces.withColumn("n_words", F.least(F.col("words") - F.col("first_word"), F.lit(max_words)))
    order = seeded_order(seed, F.col("identity"), F.col("piece"))
    pieces = cut_lineage(
        pieces.withColumn("order", order).withColumns(seeded_slices("order")).drop("words", "identity")
    )
    histogram = {r.n_words: r.n for r in pieces.groupBy("n_words").agg(F.count("*").alias("n")).collect()}
    bounds = bucket_bounds(histogram, buckets)

    before = _batches_before(histogram, bounds, batch_words)

    def listed(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("bigint") for v in values or [0]]), F.col("group"))  # null outside of the buckets

    below = F.filter(F.array(*[F.lit(b) for b in bounds or [0]]), lambda b: b < F.col("n_words"))
    sorted_in = pieces.withColumns({"group": F.when(F.col("n_words") > 0, F.size(below)).otherwise(-1), "one": F.lit(1)})
    placed = with_prefix(sorted_in, ["group"], ["slice", "coarse"], ["order", "n_words"], {"row": "one"})
    placed = placed.withColumns({
        "bucket_words": listed(bounds), "room": listed([max(1, batch_words // b) for b in bounds]), "batches_before": listed(before),
    })
    packed = F.col("group") >= 0
    return placed.select(
        "doc_id", "piece", "first_word", "n_words", F.when(packed, F.col("group")).alias("bucket"), "bucket_words",
        F.when(packed, F.col("batches_before") + F.expr("row div room")).alias("batch"),
        F.when(packed, F.col("row") % F.col("room")).cast("int").alias("slot"),
    )
