"""A Merkle manifest of a table: leaf, proof and verdict of every row, by exchanging subtrees.

Leaves are cut into superblocks of three levels of the tree. Going up, every superblock is
reduced to its top by itself, then the tops in the same way, until one node a group is left.
Going down, the nodes that the path of a superblock's top needs outside of it are exchanged:
they are cogrouped with the superblock's own nodes, and that one step reduces the superblock
again, joins the proofs and folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislelens.llm.prefix import with_prefix
from aislelens.sources.files import cut_lineage

# Nodes in a run, columns of a leaf, what claims are drawn by.
FAN, COLUMNS, TAMPERED_EVERY = 8, ("doc_id", "source", "lang", "n_chars", "text"), 3
#: Levels of a superblock.
DEPTH = 3
SUPERBLOCK = FAN**DEPTH

NODES = "group string, place bigint, n bigint, digest string"
#: Steps of a path: the place of the path's node in its run, and the others of the run. Level -1 holds the subroot.
STEPS = "group string, block bigint, level int, own int, siblings array<string>"
PROOF = "proof array<struct<own int, siblings array<string>>>"
MANIFEST = "row string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

Step = tuple[int, list[bytes]]


# ---- the tree of one superblock --------------------------------------------------------

def digest(joined: bytes) -> bytes:
    return hashlib.sha256(joined).hexdigest().encode()


def tree_levels(nodes: list[bytes], count: int) -> list[list[bytes]]:
    """Levels from neighbouring nodes up to their top; ``count`` nodes are in the whole group.

    A superblock has ``DEPTH`` levels above its nodes, or fewer if its group ends before.
    """
    levels = [nodes]
    while count > 1 and len(levels) <= DEPTH:
        below = levels[-1]
        levels.append([digest(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        count = -(-count // FAN)
    return levels


def path(levels: list[list[bytes]], place: int) -> Iterator[Step]:
    """Steps from a node of the first level to the top."""
    for level in levels[:-1]:
        own = place % FAN
        run = level[place - own : place - own + FAN]
        yield own, run[:own] + run[own + 1 :]
        place //= FAN


def fold(node: bytes, steps: list[Step]) -> bytes:
    for own, siblings in steps:
        node = digest(b"".join([*siblings[:own], node, *siblings[own:]]))
    return node


# ---- Spark -------------------------------------------------------------------------------

def leaf_hash(*values: Column) -> Column:
    """Hash of values written one after the other: ``-`` for null, else bytes, colon, value."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (group, digest, ...) with the place of a row in its group and the group's size n.

    Rows are range-partitioned and counted per partition, so a group may hold any share of them.
    """
    dealt = cut_lineage(rows.repartitionByRange("group", *order).withColumns({"part": F.spark_partition_id(), "one": F.lit(1)}))
    sizes = dealt.groupBy("group").agg(F.count("*").alias("n"))
    return cut_lineage(with_prefix(dealt, ["group"], ["part"], order, {"place": "one"}, sizes).drop("part", "one"))


def _block() -> Column:
    return F.floor(F.col("place") / SUPERBLOCK).alias("block")


def _reduced(frame: pd.DataFrame) -> list[list[bytes]]:
    return tree_levels([d.encode() for d in frame["digest"]], int(frame["n"].iloc[0]))


def _tops(nodes: DataFrame) -> DataFrame:
    """The top of every superblock, as the nodes of the next round."""

    def top(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        levels = _reduced(frame.sort_values("place"))
        return pd.DataFrame({"group": [key[0]], "place": [key[1]], "n": [-(-n // SUPERBLOCK)], "digest": [levels[-1][0].decode()]})

    return nodes.select("group", _block(), "place", "n", "digest").groupBy("group", "block").applyInPandas(top, NODES)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of every round; the last has one per group."""
    rounds = [nodes]
    while True:
        rounds.append(cut_lineage(_tops(rounds[-1])))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) <= 1:
            return rounds


def _outer_steps(frame: pd.DataFrame) -> tuple[list[Step], bytes]:
    """The steps above a superblock, and the subroot."""
    steps, subroot = [], b""
    for row in frame.sort_values("level").itertuples(index=False):
        others = [s.encode() for s in row.siblings]
        if row.level < 0:
            subroot = others[0]
        else:
            steps.append((int(row.own), others))
    return steps, subroot


def _descend(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Steps above every node's own superblock, from those above the superblock the node is in.

    ``nodes`` has to_group and to_block, the superblock of the round below that a node tops.
    """

    def exchange(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame):
            frame = frame.sort_values("place")
            levels = _reduced(frame)
            outside, subroot = _outer_steps(above)
            for i, (group, block) in enumerate(zip(frame["to_group"], frame["to_block"])):
                rows.append((group, block, -1, 0, [(subroot or levels[0][i]).decode()]))
                for level, (own, others) in enumerate([*path(levels, i), *outside]):
                    rows.append((group, block, level, own, [s.decode() for s in others]))
        return pd.DataFrame(rows, columns=["group", "block", "level", "own", "siblings"])

    dealt = nodes.select("group", _block(), "place", "n", "digest", "to_group", "to_block").groupBy("group", "block")
    return dealt.cogroup(outer.groupBy("group", "block")).applyInPandas(exchange, STEPS)


def manifest(
    docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", claim: Column | None = None, proofs: bool = False,
) -> DataFrame:
    """Leaf, subroot, root, proof and verdict of every row, one row per input row.

    A leaf is the SHA-256 of ``columns``. Leaves of one ``group`` ascend by ``order`` (nulls
    first; equal ones by leaf); eight neighbours at a time become their hash until one node,
    the group's subroot, is left. Subroots in the order of their groups (null first, by bytes)
    become the root in the same way. Columns: the order column, leaf, subroot, root,
    proof_sha256 (hash of all siblings on the way up), folded_root, verified, and with
    ``proofs`` the proof itself as (own place, siblings) per level.

    folded_root is the root that follows from the row's ``claim`` (a leaf hash; the leaf itself
    where it is null) and its original siblings; verified says whether that is the root.
    Null values count as ``-``, so a null and an empty text differ. Repeated rows are separate
    leaves. A single leaf is its own subroot and root with an empty proof; an empty table gives
    an empty result.
    """
    kind = docs.schema[order].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaf = leaf_hash(*[F.col(c) for c in columns])
    claimed = F.lit(None).cast("string") if claim is None else claim
    rows = docs.select(
        key.alias("group"), F.col(order).alias("row"), leaf.alias("digest"), claimed.alias("claim"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = _ranked(rows, [F.asc_nulls_first("row"), F.asc("digest"), F.asc("tie")])
    rounds = _rounds(leaves)

    subroots = rounds[-1].select("group", "digest")
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("to_group"), "digest")
    top_rounds = _rounds(_ranked(named, [F.asc("to_group")]))
    last = top_rounds[-1].first()
    root = last.digest if last else ""

    above = docs.sparkSession.createDataFrame([], STEPS)
    to_own = {"to_group": F.col("group"), "to_block": F.col("place")}
    for nodes in reversed(top_rounds[1:-1]):
        above = _descend(nodes.withColumns(to_own), above)
    above = cut_lineage(_descend(top_rounds[0].withColumn("to_block", F.lit(0).cast("bigint")), above))
    for nodes in reversed(rounds[1:-1]):
        above = cut_lineage(_descend(nodes.withColumns(to_own), above))

    def finish(key: tuple, frame: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(frame):
            frame = frame.sort_values("place")
            levels = _reduced(frame)
            outside, subroot = _outer_steps(outer)
            end = root.encode()
            for i, (row, node, claim) in enumerate(zip(frame["row"], levels[0], frame["claim"])):
                steps = [*path(levels, i), *outside]
                folded = fold(claim.encode() if isinstance(claim, str) else node, steps)
                proof = digest(b"".join(s for _, others in steps for s in others))
                out = (row, node.decode(), subroot.decode(), root, proof.decode(), folded.decode(), folded == end)
                rows.append(out + ([(own, [s.decode() for s in others]) for own, others in steps],) * proofs)
        names = ["row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * proofs
        return pd.DataFrame(rows, columns=names, dtype=object)

    own_row = F.col("row").cast("string").alias("row")  # pandas would turn integers beside nulls into floats
    dealt = leaves.select("group", _block(), "place", "n", "digest", own_row, "claim").groupBy("group", "block")
    finished = dealt.cogroup(above.groupBy("group", "block")).applyInPandas(finish, MANIFEST + (f", {PROOF}" if proofs else ""))
    return finished.withColumn("row", F.col("row").cast(kind)).withColumnRenamed("row", order)


def lower_cased(text: str, doc_id: str) -> Column:
    """A text whose A-Z are lower-cased where ``TAMPERED_EVERY`` divides the CRC-32 of its id; null elsewhere."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)  # ASCII: any way of lower-casing agrees, and this one is quick
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))
    return F.when(F.crc32(F.col(doc_id).cast("string").cast("binary")) % TAMPERED_EVERY == 0, lowered)


def tampered_claim() -> Column:
    """The leaf of a row with its text lower-cased; null where nothing is tampered with."""
    text = lower_cased("text", "doc_id")
    changed = leaf_hash(*[text if c == "text" else F.col(c) for c in COLUMNS])
    return F.when(text.isNotNull(), changed)
