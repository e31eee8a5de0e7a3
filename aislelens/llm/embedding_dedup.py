"""Near duplicates of embeddings by PCA-ordered tiled comparison.

Unit vectors are turned so that their leading dimensions carry most of the variance. Tiles of
neighbouring vectors are compared two by two: products of the leading dimensions come first,
the rest of a product is bounded by the norms of what is left of both vectors, and a pair is
dropped as soon as its cosine cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislelens.llm.components import Forest, components
from aislelens.llm.prefix import with_prefix
from aislelens.sources.files import cut_lineage

THRESHOLD = 0.95
#: Bytes of the vectors of one tile, and pairs of a tile compared at a time.
TILE_BYTES, CELLS = 4_000_000, 2_000_000
#: Dimensions after which the bound is tried; then all that are left.
STEPS = (8, 24)
#: Share of pairs still open above which the rest is computed for all of them at once.
DENSE = 1 / 32
#: What rounding may take from a bound.
_SLACK = 1e-9

COMPARED = "node bigint, links bigint, other bigint"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares neither overflow nor vanish
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _by_width(batch: pa.RecordBatch, index: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    widths = np.diff(batch.column(index).offsets.to_numpy())
    for width in np.unique(widths):
        yield int(width), batch.filter(pa.array(widths == width))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of each two dimensions, per task: width squared rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, part in _by_width(batch, 0):
            unit = _matrix(part.column(0), width)
            sums[width] = sums.get(width, 0) + unit.T @ unit
    for width, total in sums.items():
        yield pa.RecordBatch.from_pydict({
            "width": pa.array(np.full(width * width, width, np.int32)), "cell": pa.array(np.arange(width * width, dtype=np.int64)),
            "value": pa.array(total.ravel()),
        })


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes of falling variance about the origin, per vector width, from all vectors.

    Products are summed on the executors; width squared numbers reach the driver.
    """
    cells = vectors.mapInArrow(_moments, "width int, cell bigint, value double").groupBy("width", "cell").agg(F.sum("value").alias("value"))
    sums: dict[int, np.ndarray] = {}
    for row in cells.toLocalIterator():
        sums.setdefault(row.width, np.zeros(row.width * row.width))[row.cell] = row.value
    return {w: np.linalg.eigh(s.reshape(w, w))[1][:, ::-1].copy() for w, s in sums.items()}


def _turned(axes: dict[int, np.ndarray]):
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch, 2):
                turned = _matrix(part.column(2), width) @ axes[width]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.full(len(turned), width, np.int32)), pa.array(turned[:, 0]),
                    pa.array([row.tobytes() for row in turned], pa.binary()),
                ], names=["node", "copies", "width", "lead", "turned"])

    return turn


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) with a product of at least ``threshold``, some rows of ``a`` at a time."""
    width = a.shape[1]
    steps = [*(s for s in STEPS if s < width), width]
    rest = [[np.sqrt((m[:, s:] ** 2).sum(1)) for s in steps] for m in (a, b)]
    block = max(1, CELLS // max(1, len(b)))
    for start in range(0, len(a), block):
        rows = slice(start, start + block)
        product = a[rows, : steps[0]] @ b[:, : steps[0]].T
        bound = product + np.outer(rest[0][0][rows], rest[1][0])
        i, j = np.nonzero(bound >= threshold - _SLACK)
        open_products = product[i, j]
        for step, (low, high) in enumerate(zip(steps, steps[1:]), 1):
            if not len(i):
                break
            if len(i) > DENSE * product.size:  # many are open: one product of matrices is cheaper
                product += a[rows, low:high] @ b[:, low:high].T
                open_products = product[i, j]
            else:  # there will not be more open ones again
                open_products = open_products + np.einsum("nd,nd->n", a[start + i, low:high], b[j, low:high])
            may = open_products + rest[0][step][start + i] * rest[1][step][j] >= threshold - _SLACK
            i, j, open_products = i[may], j[may], open_products[may]
        exact = open_products >= threshold
        yield start + i[exact], j[exact]


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _compare_tiles(row, threshold)

    return compare


def _compare_tiles(row: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    nodes = [np.array(row["nodes"]), np.array(row["nodes2"])]
    copies = [np.array(row["copies"], float), np.array(row["copies2"], float)]
    a, b = (np.frombuffer(b"".join(row[m]), np.float64).reshape(-1, row["width"]) for m in ("matrix", "matrix2"))
    same = row["tile"] == row["tile2"]
    forest, found = Forest(len(a) + len(b)), [np.zeros(len(a)), np.zeros(len(b))]
    for i, j in close_pairs(a, b, threshold):
        if same:
            i, j = i[i < j], j[i < j]
        found[0] += np.bincount(i, copies[1][j], len(a))
        found[1] += np.bincount(j, copies[0][i], len(b))
        forest.link(i, len(a) + j)
        if same:
            forest.link(i, j)
    both = np.concatenate(nodes)
    left, right = forest.spanning()
    linked = np.concatenate(found)
    some = np.nonzero(linked)[0]
    yield pa.RecordBatch.from_pydict({
        "node": pa.array(np.concatenate([both[some], both[left]])),
        "links": pa.array(np.concatenate([linked[some], np.zeros(len(left))]).astype(np.int64)),
        "other": pa.array([None] * len(some) + both[right].tolist(), pa.int64()),
    })


def near_duplicates(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Links and group of every vector, one row per input row.

    Columns: vec_id, n_links (other rows linked directly: cosine of at least ``threshold``),
    component_id (smallest vec_id that can be reached, itself included), kept (vec_id =
    component_id). Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do vectors of different widths or rows without an id (component_id
    null, kept). Equal vectors are compared once and counted as often as they occur.

    Every tile meets every other one of its width whose range on the first axis is near
    enough, in a row of its own; the exact result needs no cap. Only spanning links leave a
    task. The threshold must be positive.
    """
    parts = F.col("embedding")
    table = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists(parts, lambda x: x != 0), F.lit(False))
    valid = table.filter(usable)
    nodes = valid.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))  # fixed once written

    axes = principal_axes(nodes.select("embedding"))
    turned = nodes.select("node", "copies", "embedding").mapInArrow(
        _turned(axes), "node bigint, copies bigint, width int, lead double, turned binary"
    )
    ranged = cut_lineage(turned.repartitionByRange("width", "lead").withColumns({"part": F.spark_partition_id(), "one": F.lit(1)}))
    ranked = with_prefix(ranged, ["width"], ["part"], ["lead", "node"], {"row": "one"})
    in_tile = F.greatest(F.lit(1), F.expr(f"{tile_bytes} div (8 * width)"))
    tiles = cut_lineage(
        ranked.groupBy("width", F.floor(F.col("row") / in_tile).alias("number"))
        .agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.collect_list(F.struct("node", "copies", "turned")).alias("rows"))
        .select(
            F.monotonically_increasing_id().alias("tile"), "width", "low", "high", F.col("rows.node").alias("nodes"),
            F.col("rows.copies").alias("copies"), F.col("rows.turned").alias("matrix"),
        )
    )

    # On any axis, unit vectors with the wanted cosine are at most this far apart.
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    cells = F.sequence(F.floor(F.col("low") / reach), F.floor(F.col("high") / reach))
    near = F.sequence(F.floor(F.col("low") / reach) - 1, F.floor(F.col("high") / reach) + 1)
    left = tiles.select("tile", "width", "low", "high", F.explode(cells).alias("cell"))
    right = tiles.select(F.col("tile").alias("tile2"), "width", F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(near).alias("cell"))
    meeting = (
        left.join(right, ["width", "cell"])
        .filter((F.col("tile") <= F.col("tile2")) & (F.col("low2") <= F.col("high") + reach) & (F.col("low") <= F.col("high2") + reach))
        .select("tile", "tile2").distinct()
    )
    first = tiles.select("tile", "width", "nodes", "copies", "matrix")
    second = tiles.select(*[F.col(c).alias(f"{c}2") for c in ("tile", "nodes", "copies", "matrix")])
    pairs = meeting.join(first, "tile").join(second, "tile2")
    compared = cut_lineage(pairs.mapInArrow(_compare(threshold), COMPARED))

    roots = components(compared.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    found = (
        grouped.join(least, "root").join(counts, "node", "left")
        .select("embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    linked = valid.join(found, "embedding").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = table.filter(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
