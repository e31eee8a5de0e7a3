"""Key checks of a new load against a stored table, reading only the partitions that may matter.

For every partition of the stored table a Bloom filter of its keys is kept, as rows of a table: one
row per block of 512 bits, and a key's bits lie all in one block. Filters of several loads merge
by OR. A new load's keys are looked up in all filters; only partitions with a hit are read, and the
hits are checked there exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one piece of a filter, by which its size is given.
PIECE = 32_768
#: A block's words and the bits of each; a key sets one bit in every word of its block.
WORDS, BITS = 8, 64
#: Bits per key with which some one in a hundred unknown keys hits by chance.
BITS_PER_KEY = 10


def pieces_for(keys: int) -> int:
    """Pieces of a filter for so many keys in one partition."""
    return max(1, -(-keys * BITS_PER_KEY // PIECE))


def _block(key: list[str], pieces: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *key), F.lit(pieces * PIECE // (WORDS * BITS)))


def _bit(places: str, word: int) -> Column:
    """The bit of a word that a key sets: six bits of its hash."""
    return F.shiftright(places, 6 * word).bitwiseAND(F.lit(BITS - 1)).cast("int")


def _words(of_word) -> list[Column]:
    return [of_word(w).alias(f"word_{w}") for w in range(WORDS)]


def key_filters(table: DataFrame, key: list[str], partition: list[str], pieces: int) -> DataFrame:
    """Bloom filters of a table's keys: the partition columns, block, the block's words.

    Keys are combined on the map side; a partition's filter is at most 64 rows per piece however
    many rows it has. All filters that are to merge or to be searched together need the same
    number of pieces. Rows with a NULL in the key are no keys.
    """
    known = table.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in key]))
    hashed = known.select(*partition, _block(key, pieces).alias("block"), F.xxhash64(F.lit(1), *key).alias("places"))
    return hashed.groupBy(*partition, "block").agg(
        *_words(lambda w: F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit("places", w))))
    )


def merged_filters(filters: DataFrame, partition: list[str]) -> DataFrame:
    """Filters of several loads as one per partition."""
    return filters.groupBy(*partition, "block").agg(*_words(lambda w: F.bit_or(f"word_{w}")))


def possible_partitions(new_keys: DataFrame, key: list[str], filters: DataFrame, partition: list[str], pieces: int) -> DataFrame:
    """Keys with the partitions that may hold them: all that do, and by chance a few others.

    A key meets its own block of every partition, and the bits are tested within that join: only hits become rows.
    """
    wanted = new_keys.select(*key, _block(key, pieces).alias("block"), F.xxhash64(F.lit(1), *key).alias("places"))
    is_set = [F.getbit(f"word_{w}", _bit("places", w)) == 1 for w in range(WORDS)]
    return wanted.join(filters, "block").filter(reduce(Column.__and__, is_set)).select(*key, *partition).distinct()


def _only(table: DataFrame, partition: list[str], partitions: list[tuple]) -> DataFrame:
    """The table's rows in some partitions, as a filter that reaches the list of its files.

    A row's partition is found in a set, so the test costs the same however many partitions are read.
    """
    if not partitions:
        return table.filter(F.lit(False))
    types = [table.schema[c].dataType for c in partition]
    wanted = [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(partition, p, types)]) for p in partitions]
    return table.filter(F.struct(*partition).isin(wanted))


def repeated_keys(new: DataFrame, stored: DataFrame, key: list[str], filters: DataFrame, partition: list[str], pieces: int) -> DataFrame:
    """Keys of a new load that the load repeats or the stored table has: key columns, in_load, in_table.

    The same as counting keys over both tables, but of the stored one only partitions whose
    filter hits are read. Their values (one row per partition) reach the driver while it is defined.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in key])
    counts = new.filter(known).groupBy(*key).agg(F.count(F.lit(1)).alias("in_load"))
    hits = possible_partitions(counts.select(*key), key, filters, partition, pieces)
    partitions = [tuple(r) for r in hits.select(*partition).distinct().collect()]
    found = _only(stored, partition, partitions).join(counts.select(*key), key, "left_semi")
    there = found.groupBy(*key).agg(F.count(F.lit(1)).alias("in_table"))
    both = counts.join(there, key, "left").withColumn("in_table", F.coalesce("in_table", F.lit(0)))
    return both.filter("in_load > 1 or in_table > 0")


def unknown_references(new: DataFrame, key: str, parent: DataFrame, parent_key: str, filters: DataFrame, partition: list[str], pieces: int) -> DataFrame:
    """References of a new load that the parent table lacks: key, rows.

    A key without a hit is surely unknown; keys with hits are looked up in those partitions only.
    """
    counts = new.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(parent_key)).agg(F.count(F.lit(1)).alias("rows"))
    hits = possible_partitions(counts.select(parent_key), [parent_key], filters, partition, pieces)
    partitions = [tuple(r) for r in hits.select(*partition).distinct().collect()]
    known = _only(parent, partition, partitions).select(parent_key)
    return counts.join(known, parent_key, "left_anti").select(F.col(parent_key).alias(key), "rows")
