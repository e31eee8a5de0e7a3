"""Centroid clustering of integer vectors by bit planes and popcounts.

A vector of 64 integers is kept as its bit planes in two's complement: plane k is one 64-bit
word that holds bit k of every component, and the last plane counts negative. Dot products
are weighted popcounts of planes under AND, so products and distances are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislelens.sources.files import cut_lineage

# Components of a vector, their scale, centroids, rounds, seed of the first centroids.
WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Components saturate at this size, so that every squared distance fits 63 bits.
LARGEST = (1 << 27) - 1
#: Distances computed at a time.
CELLS = 1_000_000


# ---- planes --------------------------------------------------------------------------

def plane_counts(values: np.ndarray) -> np.ndarray:
    """Planes that each row of integers needs: the bits of its largest component and a sign."""
    largest = (values ^ (values >> 63)).max(1)
    return np.frexp(largest.astype(np.float64))[1].astype(np.int64) + 1


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Rows of 64 integers to rows of ``planes`` words; component 0 is the lowest bit."""
    out = np.empty((len(values), planes), np.uint64)
    for k in range(planes):
        bits = ((values >> k) & 1).astype(np.uint8)
        out[:, k] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def plane_weights(planes: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes, dtype=np.int64)
    weights[-1] = -weights[-1]
    return weights


def from_planes(planes: np.ndarray) -> np.ndarray:
    values = np.zeros((len(planes), WIDTH), np.int64)
    for k, weight in enumerate(plane_weights(planes.shape[1])):
        words = np.ascontiguousarray(planes[:, k]).astype("<u8").view(np.uint8).reshape(-1, 8)
        values += weight * np.unpackbits(words, axis=1, bitorder="little")
    return values


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows of planes ``a`` with rows of planes ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i, left in enumerate(plane_weights(a.shape[1])):
        for j, right in enumerate(plane_weights(b.shape[1])):
            out += left * right * np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """The product of every row of planes with itself."""
    out = np.zeros(len(a), np.int64)
    weights = plane_weights(a.shape[1])
    for i, left in enumerate(weights):
        for j, right in enumerate(weights):
            out += left * right * np.bitwise_count(a[:, i] & a[:, j]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equally near ones) and squared distance."""
    cluster, distance = np.empty(len(planes), np.int32), np.empty(len(planes), np.int64)
    theirs = squares(centroids)
    step = max(1, CELLS // len(centroids))
    for i in range(0, len(planes), step):
        rows = planes[i : i + step]
        apart = squares(rows)[:, None] + theirs[None, :] - 2 * dot_products(rows, centroids)
        cluster[i : i + step] = apart.argmin(1)
        distance[i : i + step] = apart.min(1)
    return cluster, distance


def _rows_by_planes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows with equally many planes, and their planes."""
    counts = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(counts) - counts
    for n in np.unique(counts):
        at = np.nonzero(counts == n)[0]
        yield at, flat[starts[at][:, None] + np.arange(n)]


# ---- Spark ---------------------------------------------------------------------------

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        scaled = np.floor(SCALE * batch.column(1).flatten().to_numpy().reshape(-1, WIDTH))
        values = np.clip(scaled, -LARGEST - 1, LARGEST).astype(np.int64)
        counts = plane_counts(values)
        ids, words = [], []
        for n in np.unique(counts):
            at = np.nonzero(counts == n)[0]
            ids.append(batch.column(0).take(pa.array(at)))
            flat = pa.array(to_planes(values[at], int(n)).view(np.int64).ravel())
            words.append(pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(at) + 1, n, dtype=np.int32)), flat))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(words)], names=["vec_id", "planes"])


def packed_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The vectors of 64 finite components as (vec_id, planes) of the integers floor(64 * x)."""
    table = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.filter((F.size("embedding") == WIDTH) & finite).mapInArrow(_packed, "vec_id bigint, planes array<bigint>")


def first_centroids(packed: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hash of ``seed:vec_id``; those without an id come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = packed.orderBy(F.asc_nulls_last(order), "planes").select("planes").limit(centroids).collect()
    parts = [from_planes(np.array([r.planes], np.int64).view(np.uint64)) for r in rows]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.int64)


def _as_planes(centroids: np.ndarray) -> np.ndarray:
    return to_planes(centroids, int(plane_counts(centroids).max()))


def _cluster_sums(centroids: np.ndarray):
    """Per task one row for each centroid: how many vectors it has and their sums."""
    theirs = _as_planes(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(theirs), np.int64), np.zeros((len(theirs), WIDTH), np.int64)
        for batch in batches:
            for _, planes in _rows_by_planes(batch.column(0)):
                cluster, _ = nearest(planes, theirs)
                values = from_planes(planes)
                for c in np.unique(cluster):
                    own = cluster == c
                    count[c] += own.sum()
                    total[c] += values[own].sum(0)
        some = np.nonzero(count)[0]
        if len(some):
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(some.astype(np.int32)), "n": pa.array(count[some]),
                "total": pa.array(total[some].tolist(), pa.list_(pa.int64())),
            })

    return sums


def _moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors moves to the floor of their mean. One row per centroid reaches the driver."""
    parts = packed.select("planes").mapInArrow(_cluster_sums(centroids), "cluster int, n bigint, total array<bigint>")
    totals = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(WIDTH)]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        moved[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(WIDTH)]
    return moved


def _assigned(centroids: np.ndarray):
    theirs = _as_planes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, planes in _rows_by_planes(batch.column(1)):
                cluster, distance = nearest(planes, theirs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"]
                )

    return assign


@dataclass
class Clustering:
    """``vectors`` (vec_id, cluster, distance) and the integer components of the centroids."""

    vectors: DataFrame
    centroids: np.ndarray


def cluster(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED,
) -> Clustering:
    """Nearest centroid of every vector after ``rounds`` rounds.

    Kept are vectors of exactly 64 components, none null or not finite; a component x counts as
    floor(64 * x), saturated at ``LARGEST``. The first centroids are the kept vectors with the
    smallest SHA-256 of ``seed:vec_id`` (equal ones by their planes; vectors without an id
    last). A round assigns every vector to its nearest centroid, the smaller number if several
    are equally near, and moves each centroid that has vectors to the floor of their mean; the others
    stay. Then vectors are assigned once more. Repeated rows are separate vectors. With fewer
    vectors than centroids there are as many centroids as vectors, so no vectors give an
    empty result. Only the columns named are read.

    The planes are written once and read in every round; vectors are never shuffled, a task
    sends one row per centroid, and the driver holds the centroids alone.
    """
    packed = cut_lineage(packed_vectors(vectors, vec_id, embedding))
    now = first_centroids(packed, centroids, seed)
    if not len(now):
        return Clustering(packed.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), now)
    for _ in range(rounds):
        now = _moved(packed, now)
    return Clustering(packed.mapInArrow(_assigned(now), "vec_id bigint, cluster int, distance bigint"), now)


def digest(found: Clustering) -> DataFrame:
    """The clustering with inertias (null beyond 63 bits) and a hash of each vector's final centroid."""
    rows = cut_lineage(found.vectors)
    parts = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    own = {r.cluster: int(r.own) for r in parts.collect()}  # one row per centroid
    facts = [
        (i, _as_long(own[i]), _as_long(sum(own.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for i, c in enumerate(found.centroids) if i in own
    ]
    named = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select(  # one row per centroid
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    )


def _as_long(total: int) -> int | None:
    return total if total < 1 << 63 else None
