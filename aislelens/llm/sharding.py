"""Contiguous, balanced shards by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislelens.llm.prefix import with_prefix
from aislelens.sources.files import cut_lineage

# Number of shards, bytes that a row takes besides its text.
SHARDS, ROW_BYTES = 40, 16


def _rows(docs: DataFrame, extra: list[str]) -> DataFrame:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"), *extra,
    )


_KEY = ["doc_id", "size", "text_crc32"]


def _order() -> list[Column]:
    return [F.asc_nulls_last("doc_id"), F.asc("size"), F.asc("text_crc32")]


def assign(docs: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """Shard and place of every document, one row per input row, without moving texts.

    Columns: doc_id, size (UTF-8 bytes of the text and ``ROW_BYTES``), text_crc32 (null text
    as empty), shard, slot (0, 1, ... in each shard). Documents lie in the order of doc_id
    (nulls last; then size and checksum) and a document belongs to the shard in which its
    middle byte falls, so shards are contiguous and differ from the mean by less than the
    largest document.
    """
    # Repeated rows are dealt apart by a number that is written down with them.
    dealt = cut_lineage(
        _rows(docs, [F.monotonically_increasing_id().alias("tie")])
        .repartitionByRange(*_order(), F.asc("tie"))
        .withColumn("part", F.spark_partition_id())
        .withColumns({"whole": F.lit(1), "one": F.lit(1)})
    )
    placed = with_prefix(dealt, ["whole"], ["part"], [*_order(), F.asc("tie")], {"before": "size", "row": "one"})
    total = dealt.agg(F.sum("size")).first()[0] or 1
    middle = F.expr(f"((2 * before + size) * {shards}) div {2 * total}L")
    cut = placed.withColumn("shard", middle.cast("int"))
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))
    slots = cut.join(F.broadcast(first), "shard")  # one row per shard
    return slots.select(*_KEY, "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, *, shards: int = SHARDS, column: str = "shard") -> None:
    """Write the documents, all columns, as ``path/<column>=<n>/``: each shard in order, over as many files as it needs.

    The first document of every shard (one row each reaches the driver) decides by
    comparison; identical rows stay together. A column of that name in the documents is
    refused: give another name.
    """
    if column.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the documents have a column {column} themselves")
    firsts = sorted(assign(docs, shards=shards).filter("slot = 0").collect(), key=lambda r: r.shard)
    key = F.struct(*[c.alias(n) for n, c in zip("abcd", _key_columns())])
    marked = docs.select(F.struct("*").alias("row"), key.alias("key"))
    shard = F.lit(firsts[0].shard if firsts else 0)
    for row in firsts[1:]:
        numbers = [F.lit(x).cast("bigint").alias(n) for n, x in zip("bcd", (row.doc_id or 0, row.size, row.text_crc32))]
        start = F.struct(F.lit(row.doc_id is None).alias("a"), *numbers)
        shard = F.when(F.col("key") >= start, row.shard).otherwise(shard)
    dealt = marked.withColumn("shard", shard).repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    dealt.select("row.*", F.col("shard").alias(column)).write.partitionBy(column).parquet(path)


def _key_columns() -> list[Column]:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return [
        F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)),
        (F.octet_length(body) + ROW_BYTES).cast("bigint"), F.crc32(body),
    ]
