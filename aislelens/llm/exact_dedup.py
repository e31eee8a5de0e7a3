"""Exact duplicates by Patricia tries.

Texts are dealt by length and content hash. Tries over whole byte strings decide equality,
first over the rows of each input task, so that a text copied a billion times is shuffled
once per task, then over what the tasks send.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text and ids that a task's trie holds before it spills a subtree.
TRIE_BYTES = 48_000_000
#: Bytes of text in one Arrow batch that leaves a task.
BATCH_BYTES = 4_000_000
#: Rows that a task remembers to drop repeats before the shuffle.
SEEN = 100_000
_PER_ROW = 120  # bytes of Python objects that a row takes besides its text

LOCAL = pa.schema([
    ("length", pa.int64()), ("hash", pa.int64()), ("sha", pa.string()), ("body", pa.binary()),
    ("first_id", pa.int64()), ("ids", pa.list_(pa.int64())),
])
OWNED = pa.schema([("keep_id", pa.int64()), ("sha", pa.string()), ("ids", pa.list_(pa.int64())), ("lead", pa.bool_())])


def normalised(text: str = "text") -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _id_order(x: int | None) -> tuple:
    return (x is None, x or 0)


class Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry: object = None) -> None:
        self.label, self.children, self.entry = label, {}, entry


class PatriciaTrie:
    """A compressed radix trie over byte strings; every stored string ends in a node's ``entry``."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.held: dict[int, int] = {}  # bytes below the root by first byte, -1 for the empty string
        self.total = 0

    def find(self, key: bytes) -> Node:
        """The node at which ``key`` ends, made if need be."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                return child
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            fork = Node(label[:same])
            child.label = label[same:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            node, at = fork, at + same
        return node

    def weigh(self, key: bytes, more: int) -> int:
        """Count bytes to the subtree that holds ``key``; the total."""
        first = key[0] if key else -1
        self.held[first] = self.held.get(first, 0) + more
        self.total += more
        return self.total

    def spill(self) -> Iterator[tuple[bytes, object]]:
        """Take out the heaviest subtree of the root: its strings and entries."""
        first = max(self.held, key=self.held.get)
        self.total -= self.held.pop(first)
        if first < 0:
            entry, self.root.entry = self.root.entry, None
            yield b"", entry
            return
        stack = [(b"", self.root.children.pop(first))]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            if node.entry is not None:
                yield key, node.entry
            stack.extend((key, child) for child in node.children.values())


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    pending, size = [], 0
    for row in rows:
        pending.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield _arrow(pending, schema)
            pending, size = [], 0
    if pending:
        yield _arrow(pending, schema)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _local_owners(budget: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = PatriciaTrie()
        for batch in batches:
            for doc_id, body, length, code, sha in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                node = trie.find(body)
                more = _PER_ROW
                if node.entry is None:
                    node.entry = (length, code, sha, [])
                    more += 2 * len(body) + _PER_ROW
                node.entry[3].append(doc_id)
                if trie.weigh(body, more) > budget:
                    yield from map(_local_row, trie.spill())
        while trie.held:
            yield from map(_local_row, trie.spill())

    return lambda batches: _batches(rows(batches), LOCAL, lambda r: len(r[3]) + 8 * len(r[5]))


def _local_row(found: tuple[bytes, tuple]) -> tuple:
    body, (length, code, sha, ids) = found
    ids.sort(key=_id_order)
    return length, code, sha, body, ids[0], ids


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by length, hash and smallest id: the first one of a text owns it."""

    def rows() -> Iterator[tuple]:
        trie, at = PatriciaTrie(), None
        for batch in batches:
            for length, code, sha, body, first_id, ids in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                if (length, code) != at:
                    trie, at = PatriciaTrie(), (length, code)
                node = trie.find(body)
                lead = node.entry is None
                if lead:
                    node.entry = (first_id,)
                yield node.entry[0], sha, ids, lead

    return _batches(rows(), OWNED, lambda r: 100 + 8 * len(r[2]))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def duplicates(docs: DataFrame, *, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """Owner of every document's text.

    One row per input row: doc_id, keep_id (smallest id with an equal text), group_size,
    kept, text_sha256. Null text equals empty text. A row without an id owns a text only if
    no row has one (then keep_id is null). Of repeated rows with the same id one is kept.
    """
    text = normalised()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("body")).select(
        "doc_id", F.col("body").cast("binary").alias("body"), F.octet_length("body").cast("bigint").alias("length"),
        F.xxhash64("body").alias("hash"), F.sha2("body", 256).alias("sha"),
    )
    local = rows.mapInArrow(_local_owners(trie_bytes), _ddl(LOCAL))
    dealt = local.repartition("length", "hash").sortWithinPartitions("length", "hash", F.asc_nulls_last("first_id"))
    owned = dealt.mapInArrow(_owners, _ddl(OWNED))
    # One row per text and input task from here on: sizes add up without a hot key.
    same = Window.partitionBy("sha", "keep_id")
    sized = owned.withColumn("group_size", F.sum(F.size("ids").cast("bigint")).over(same))
    members = sized.select("keep_id", "sha", "lead", "group_size", F.posexplode("ids").alias("at", "doc_id"))
    return members.select(
        "doc_id", "keep_id", "group_size", (F.col("lead") & (F.col("at") == 0)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _new_in_task(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """False for rows that repeat one of the last rows of the task; other repeats are met after the shuffle."""
    seen: set[tuple] = set()
    for keys, shas in batches:
        new = []
        for pair in zip(keys, shas):
            new.append(pair not in seen)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(pair)
        yield pd.Series(new, dtype=bool)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, unchanged, that own their text: exactly one of equal ones.

    Columns of any name and number are kept as they are. Rows that share both id and text
    (or have no id) leave a task once, however many there are.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = duplicates(docs).filter("kept").select(key.alias("key"), F.col("text_sha256").alias("sha"))
    marked = docs.select(F.struct("*").alias("row"), key.alias("key"), F.sha2(normalised(), 256).alias("sha"))
    once = Window.partitionBy("key", "sha").orderBy("sha")
    new = F.pandas_udf(_new_in_task, "boolean").asNondeterministic()  # it has a state: not to be moved
    found = marked.filter(new("key", "sha")).join(kept, ["key", "sha"], "left_semi").withColumn("copy", F.row_number().over(once))
    return found.filter("copy = 1").select("row.*")
