import hashlib
import zlib
from collections import Counter

import pytest
from frames import AWKWARD, documents

from aislelens.llm import merkle, queries

SF = "/root/testdata/sf0.01"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """Top of a list of nodes, and the runs that each of them passes."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            p.append((i % 8, nodes[i - i % 8 : i - i % 8 + 8]))
        at = [i // 8 for i in at]
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return (nodes[0] if nodes else None), paths


def plain(rows):
    """The whole manifest in one process."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = climb([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, above):
        for (_, _, h, r), steps in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            drawn = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) if drawn else h
            siblings = ""
            for own, run in [*steps, *top]:
                siblings += "".join(run[:own] + run[own + 1 :])
                node = sha("".join([*run[:own], node, *run[own + 1 :]]))
            out.append((r.doc_id, h, trees[g][0], root, sha(siblings), node, node == root))
    return sorted(out, key=str)


def result(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    wanted = plain(rows)
    assert result(queries.op11_merkle_manifest(spark, SF)) == wanted
    assert {True, False} == {w[-1] for w in wanted}


def test_awkward_rows_and_clashing_columns(spark):
    docs = documents(spark, AWKWARD + [(2**60 + i, "T", "fr", None) for i in range(40)], clashing=True)
    for name in ("place", "n", "digest", "claim", "tie", "group", "block", "level", "leaf", "root", "part"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    assert result(merkle.manifest(docs, claim=merkle.tampered_claim())) == plain(docs.collect())


@pytest.mark.parametrize("sizes", [[1], [8, 9], [512, 513], [1, 64, 65, 4097], [2] * 70])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(i, f"Text {i}", f"l{g:03}", "s") for g, n in enumerate(sizes) for i in range(1000 * g, 1000 * g + n)]
    docs = documents(spark, rows)
    assert result(merkle.manifest(docs, claim=merkle.tampered_claim())) == plain(docs.collect())


def test_a_group_without_ids_and_repeated_rows(spark):
    docs = documents(spark, [(None, "same", "en")] * 700 + [(5, "same", "en")] * 30 + [(4, None, None)])
    assert result(merkle.manifest(docs, claim=merkle.tampered_claim())) == plain(docs.collect())


def test_proofs_lead_to_the_root(spark):
    docs = documents(spark, [(i, f"t{i}", "abc"[i % 3]) for i in range(100)])
    rows = merkle.manifest(docs, proofs=True).collect()
    assert len(rows) == 100 and all(r.verified for r in rows)
    for r in rows:
        steps = [(s.own, [x.encode() for x in s.siblings]) for s in r.proof]
        assert merkle.fold(r.leaf.encode(), steps).decode() == r.root
        assert sha("".join(x for s in r.proof for x in s.siblings)) == r.proof_sha256
    assert Counter(len(r.proof) for r in rows) == {3: 100}


def test_any_change_is_noticed(spark):
    docs = documents(spark, [(i, f"t{i}", "en") for i in range(20)])
    claim = merkle.leaf_hash(*[merkle.F.col(c) for c in merkle.COLUMNS[:-1]], merkle.F.concat("text", merkle.F.lit(" ")))
    assert not any(r.verified for r in merkle.manifest(docs, claim=claim).collect())


def test_empty_table(spark):
    empty = merkle.manifest(documents(spark, [(1, "a")]).limit(0))
    assert empty.count() == 0 and "folded_root" in empty.columns
