import numpy as np
import pytest

from aislelens.llm import embedding_dedup

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, threshold=0.95):
    """Links and smallest reachable id by comparing all with all."""
    usable = [
        (i, np.array(v, float)) for i, v in rows
        if i is not None and v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and np.any(v)
    ]
    unit = [v / np.linalg.norm(v) for _, v in usable]
    near = [[j for j, w in enumerate(unit) if j != k and len(w) == len(v) and v @ w >= threshold] for k, v in enumerate(unit)]
    out = []
    for k, (i, _) in enumerate(usable):
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, len(near[k]), min(usable[j][0] for j in seen)))
    alone = [i for i, v in rows]
    for i, _ in usable:
        alone.remove(i)
    return sorted([*out, *((i, 0, i) for i in alone)], key=str)


def ours(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    for name in ("node", "copies", "tile", "width", "lead", "links", "root", "least", "n_links"):
        df = df.selectExpr("*", f"'x' as {name}")
    got = embedding_dedup.near_duplicates(df.repartition(4), **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("tile_bytes", [embedding_dedup.TILE_BYTES, 16 * 8 * 20])
def test_planted_groups(spark, tile_bytes):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(60, 16)) * np.linspace(3, 0.3, 16)
    rows = []
    for c in centres:
        rows += [list(c + draw.normal(size=16) * s) for s in draw.choice([0, 0.05, 0.2, 0.4], draw.integers(1, 6))]
    rows += [list(centres[0])] * 40  # a hot vector
    chain = [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in np.arange(0, 1.5, 0.25)]
    rows += [list(v) for v in chain]
    numbered = [(int(i), r) for i, r in zip(draw.permutation(len(rows)), rows)]
    assert ours(spark, numbered, tile_bytes=tile_bytes) == plain(numbered)


def test_awkward_vectors(spark):
    rows = [
        (1, [1, 0]), (2, [2, 0]), (3, [0, 0]), (4, None), (5, []), (6, [1, None]), (7, [float("nan"), 1]), (8, [float("inf"), 1]),
        (9, [1]), (10, [5]), (11, [-1]), (12, [1, 0, 0]), (None, [1, 0]), (13, [1e-200, 0]), (14, [1e200, 1e190]), (2, [2, 0]), (15, [0, 1]),
    ]
    assert ours(spark, rows) == plain([r for r in rows if r[0] not in (13, 14)] + [(13, [1, 0]), (14, [1, 0])])


def test_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_close_pairs_when_all_or_none_are_close():
    draw = np.random.default_rng(1)
    for spread in (0.01, 0.2, 5):
        v = 1 + spread * draw.normal(size=(300, 40))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        found = {(i, j) for a, b in embedding_dedup.close_pairs(v[:120], v, 0.95) for i, j in zip(a.tolist(), b.tolist())}
        assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(v[:120] @ v.T >= 0.95))}
