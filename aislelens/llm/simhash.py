"""Near duplicates by SimHash with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislelens.llm.components import Forest, components, other_key
from aislelens.sources.files import cut_lineage

# Words in a shingle, seed of the hash, differing bits of a link.
SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Segments of the ring. With d bits allowed, all but d segments of a linked pair are equal,
#: and every choice of that many segments is one key.
SEGMENTS = 6
#: Fingerprints of one key that are compared as one tile.
TILE = 32_768
#: Candidates per fingerprint and key above which finer segments are taken.
CANDIDATES = 64
_CELLS = 1_000_000  # pairs compared at a time
_HASHED = 8_192  # shingles counted at a time
#: Tasks over which pairs of tiles are dealt.
MOST_TASKS = 100_000

LINKS = "a bigint, b bigint, slot int, value bigint, tile bigint, members array<bigint>"


# ---- fingerprints --------------------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits, signed: a bit is 1 if it is set in over half of the shingles' hashes.

    Shingles are runs of words of the text, A-Z lower-cased, joined by one space; repeats
    count. Fewer words are one shingle; no words give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        bounds = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        bounds = list(zip((ends - lengths)[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(bounds), _HASHED):
        part = bounds[i : i + _HASHED]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(bounds), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("bigint")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return hashed(text.cast("binary"))


# ---- the ring ------------------------------------------------------------------------

def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Masks of 64 bits cut into nearly equal segments."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def segments_for(rows: int, max_bits: int = MAX_BITS) -> int:
    """Segments with which a key has some ``CANDIDATES`` of ``rows`` random fingerprints at most; links don't depend on it."""
    segments = max_bits + 2
    while rows >> (64 * (segments - max_bits) // segments) > CANDIDATES:
        segments += 1
    return segments


def on_ring(differing: np.ndarray, max_bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """Pairs that may be close, given the bits in which they differ.

    If at most ``max_bits`` bits differ, then from some segment of the ring on, every chain of
    l consecutive segments holds at most l / segments of them. Pairs without such a start
    cannot be close.
    """
    parts = [np.bitwise_count(differing & np.uint64(m)) for m in segment_masks(segments)]
    passing = np.zeros(len(differing), bool)
    for start in range(segments):
        total, chain = np.zeros(len(differing), np.uint8), np.ones(len(differing), bool)
        for length in range(1, segments + 1):
            total = total + parts[(start + length - 1) % segments]
            chain &= total <= length * max_bits // segments
            if not chain.any():
                break
        passing |= chain
    return passing


def _close(x: np.ndarray, max_bits: int, segments: int) -> np.ndarray:
    """Rows of ``x`` (differing bits) that pass the ring and then the full count."""
    near = np.nonzero(on_ring(x, max_bits, segments))[0]
    return near[np.bitwise_count(x[near]) <= max_bits]


def _link_runs(run: np.ndarray, fps: np.ndarray, forest: Forest, bits: tuple[int, int]) -> None:
    """Compare the rows of each run with each other; runs are sorted and short."""
    i, lag = np.arange(len(run)), 1
    while len(i := i[i + lag < len(run)]) and len(i := i[run[i] == run[i + lag]]):
        close = i[_close(fps[i] ^ fps[i + lag], *bits)]
        forest.link(close, close + lag)
        lag += 1


def _link_blocks(a: np.ndarray, b: np.ndarray, at_a: int, at_b: int, forest: Forest, bits: tuple[int, int]) -> None:
    """Compare all of ``a`` with all of ``b``, some rows at a time."""
    step = max(1, _CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        x = (a[i : i + step, None] ^ b[None, :]).ravel()
        close = _close(x, *bits)
        forest.link(at_a + i + close // len(b), at_b + close % len(b))


def _links(pairs: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(pairs["a"])
    empty = {"slot": pa.int32(), "value": pa.int64(), "tile": pa.int64(), "members": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict(
        {"a": pa.array(pairs["a"]), "b": pa.array(pairs["b"]), **{c: pa.nulls(n, t) for c, t in empty.items()}}
    )


def _tiles(slot: int, value: int, members: np.ndarray, number: int) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_pydict({
        "a": none, "b": none, "slot": pa.array([slot], pa.int32()), "value": pa.array([value], pa.int64()),
        "tile": pa.array([number], pa.int64()), "members": pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), pa.array(members)),
    })


def _compare_runs(bits: tuple[int, int], tile: int):
    """Rows come sorted by key: links within every key, or within each tile of a long key.

    Rows of one key may lie in several tasks, and only a task's first and last key can go on in
    another one; those and the tiles of long keys are handed on to be compared with each other.
    """

    def block(slots: np.ndarray, values: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        run = np.concatenate([[0], np.cumsum((np.diff(slots) != 0) | (np.diff(values) != 0))])
        forest = Forest(len(fps))
        sizes = np.bincount(run)
        first = np.concatenate([[0], np.cumsum(sizes)])
        for r in np.nonzero(sizes > 64)[0]:
            own = fps[first[r] : first[r + 1]]
            _link_blocks(own, own, first[r], first[r], forest, bits)
        few = np.nonzero((sizes <= 64)[run])[0]
        part = Forest(len(few))
        _link_runs(run[few], fps[few], part, bits)
        forest.link(*(few[rows] for rows in part.spanning()))
        a, b = forest.spanning()
        return _links({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # of the next tile
        held = [np.zeros(0, np.int64)] * 3  # the key at the end of the batch, and its rows
        shared = True  # the first key, and every key of which a tile went out
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            slots, values, fps = rows
            if not len(fps):
                continue
            ends = np.nonzero((np.diff(slots) != 0) | (np.diff(values) != 0))[0] + 1
            if len(ends) and shared:  # that key has ended: its rest is a tile
                end = int(ends[0])
                yield block(slots[:end], values[:end], fps[:end].view(np.uint64))
                yield _tiles(int(slots[0]), int(values[0]), fps[:end], number)
                number, shared = number + 1, False
                slots, values, fps, ends = slots[end:], values[end:], fps[end:], ends[1:] - end
            if len(ends):
                cut = int(ends[-1])
                yield block(slots[:cut], values[:cut], fps[:cut].view(np.uint64))
                slots, values, fps = slots[cut:], values[cut:], fps[cut:]
            while len(fps) > tile:
                yield block(slots[:tile], values[:tile], fps[:tile].view(np.uint64))
                yield _tiles(int(slots[0]), int(values[0]), fps[:tile], number)
                slots, values, fps, number, shared = slots[tile:], values[tile:], fps[tile:], number + 1, True
            held = [slots, values, fps]
        slots, values, fps = held
        if len(fps):
            yield block(slots, values, fps.view(np.uint64))
            yield _tiles(int(slots[0]), int(values[0]), fps, number)

    return compare


def _compare_tiles(bits: tuple[int, int]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                fps = np.concatenate([left.values.to_numpy(), right.values.to_numpy()])
                forest, n = Forest(len(fps)), len(left.values)
                _link_blocks(fps[:n].view(np.uint64), fps[n:].view(np.uint64), 0, n, forest, bits)
                a, b = forest.spanning()
                yield pa.RecordBatch.from_pydict({"a": pa.array(fps[a]), "b": pa.array(fps[b])})

    return compare


def links(fps: DataFrame, *, max_bits: int = MAX_BITS, segments: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``max_bits`` of each other, directly or by others.

    ``fps`` has one column of different values. Two of them share at least
    ``segments - max_bits`` segments, so they meet under one of the keys made of that many;
    there the ring is tried before the bits are counted. Of each group of linked rows a
    spanning tree is returned, not all pairs. Unless given, the number of segments follows
    from the number of fingerprints.

    Keys are dealt out by ranges, so a frequent key lies in several tasks. What a task has of
    its first and last key, and at most ``tile`` values of a longer key, is a tile; tiles of
    one key are compared two by two, each two in a row of their own.
    """
    name = fps.columns[0]
    segments = segments or segments_for(fps.count(), max_bits)
    masks = segment_masks(segments)
    keys = [sum(masks[i] for i in c) for c in combinations(range(segments), segments - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in keys]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.col(name).bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)])
    keyed = fps.select(F.explode(slots).alias("k"), F.col(name).alias("fp")).select("k.slot", "k.value", "fp")
    dealt = keyed.repartitionByRange("slot", "value", "fp").sortWithinPartitions("slot", "value")
    found = cut_lineage(dealt.mapInArrow(_compare_runs((max_bits, segments), tile), LINKS))
    named = found.filter("tile is not null").select("slot", "value", "tile")
    later = named.select("slot", "value", F.col("tile").alias("later"))
    pairs = cut_lineage(named.join(later, ["slot", "value"]).filter("tile < later").select("tile", "later"))
    own = found.filter("a is not null").select("a", "b")
    if not (n := pairs.count()):
        return own
    members = found.filter("tile is not null").select("tile", "members")
    others = members.select(F.col("tile").alias("later"), F.col("members").alias("others"))
    both = pairs.join(members, "tile").join(others, "later")
    dealt_pairs = both.repartition(min(n, MOST_TASKS), "tile", "later").select("members", "others")
    return own.unionAll(dealt_pairs.mapInArrow(_compare_tiles((max_bits, segments)), "a bigint, b bigint"))


def _fingerprinted(docs: DataFrame, shingle: int, *more: Column) -> DataFrame:
    return cut_lineage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), fingerprint_column(F.col("text"), shingle).alias("fp"), *more
    ))


def _rooted(fps: DataFrame, max_bits: int, *least: Column) -> DataFrame:
    """Every different fingerprint with the smallest fingerprint of its group as ``root``, and aggregates over its rows."""
    nodes = fps.groupBy("fp").agg(*least)
    roots = components(links(cut_lineage(fps.select("fp").distinct()), max_bits=max_bits)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Fingerprint and group of every document, one row per input row.

    Columns: doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that can
    be reached by links, itself included; null if no document of the group has an id. Null
    text has no words. Documents with equal fingerprints are one node of the link graph.
    """
    fps = _fingerprinted(docs, shingle)
    grouped = _rooted(fps, max_bits, F.min("doc_id").alias("least"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id")).select(other_key("root"), "component_id")
    members = grouped.select("fp", other_key("root")).join(least, "key").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(members, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents, unchanged, without near duplicates: one document of each group stays.

    That is the one with the smallest doc_id; documents without an id come after all others,
    and those of one id are ordered by a hash of their text. A document is its id and its
    text, so of rows with one id and different texts each is judged by itself, and rows that
    repeat id and text stay or go together.
    """
    text_hash = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    fps = _fingerprinted(docs, shingle, text_hash.alias("hash"))
    document = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    grouped = _rooted(fps, max_bits, F.min(document).alias("least"))
    owners = grouped.groupBy("root").agg(F.min("least").alias("owner")).select(other_key("root"), "owner")
    owned = grouped.select("fp", other_key("root")).join(owners, "key").select("fp", "owner")
    others = fps.join(owned, "fp").filter(document != F.col("owner")).select(F.col("doc_id").alias("_copy"), F.col("hash").alias("_hash"))
    same = docs["doc_id"].cast("bigint").eqNullSafe(others["_copy"]) & (F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")) == others["_hash"])
    return docs.join(others.distinct(), same, "left_anti")
