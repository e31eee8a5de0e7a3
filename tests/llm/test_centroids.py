import hashlib
import math
import random

import numpy as np
import pytest

from aislelens.llm import centroids, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, k=16, rounds=3):
    """The same clustering with Python's integers, one vector at a time."""
    kept = [
        (i, [max(-centroids.LARGEST - 1, min(centroids.LARGEST, math.floor(64 * x))) for x in v])
        for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in named][:k]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(means))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, own in groups.items():
            means[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    out = []
    for i, d, n in found:
        sha = hashlib.sha256(",".join(map(str, means[n])).encode()).hexdigest()
        out.append((i, n, d, sum(x for _, x, m in found if m == n), sum(x for _, x, _ in found), sha))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_products_of_planes_are_exact():
    draw = np.random.default_rng(3)
    for low, high in ((0, 1), (-1, 1), (-5, 5), (-64, 64), (-centroids.LARGEST - 1, centroids.LARGEST + 1)):
        a, b = (draw.integers(low, high, (9, 64)) for _ in range(2))
        a[0] = low
        n, m = (int(centroids.plane_counts(x).max()) for x in (a, b))
        pa, pb = centroids.to_planes(a, n), centroids.to_planes(b, m)
        assert (centroids.from_planes(pa) == a).all()
        assert (centroids.dot_products(pa, pb) == a @ b.T).all()
        assert (centroids.squares(pa) == (a * a).sum(1)).all()


def test_all_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(queries.op13_centroid_clusters(spark, SF)) == plain(rows)


def test_awkward_vectors(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(64)]) for i in range(60)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (100, [0.0] * 64), (101, [1e300] * 64), (102, [-1e9] * 63 + [0.5])]
    rows += [(103, None), (104, []), (105, [0.5] * 63), (106, [0.5] * 65), (107, [None] * 64), (108, [math.nan] * 64), (109, [math.inf] * 64)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # equally near to equal centroids
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4)
    for name in ("planes", "cluster", "distance", "n", "own", "whole", "centroid_sha256", "a.b"):
        df = df.selectExpr("*", f"'x' as `{name}`")
    assert result(centroids.digest(centroids.cluster(df))) == plain(rows)


def test_rows_without_an_id_are_assigned(spark):
    rows = [(1, [0.0] * 64), (None, [1.0] * 64), (None, None)]
    found = centroids.cluster(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), centroids=1, rounds=0)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in found.vectors.collect()) == [(0, 0, 64 * 64 * 64), (1, 0, 0)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)]])
def test_few_or_no_vectors(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert result(centroids.digest(centroids.cluster(df))) == plain(rows)
