import re

import pytest
from frames import AWKWARD, documents

import __spark_entry__ as contract
import corpus_pipeline
from aislelens.llm import exact_dedup, language, mixture, queries, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs, corpus_pipeline.cut_lineage(stage(spark, docs, SF))))
        docs = out[-1][1]
    return out


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "source_mix", "packing"]
    assert all(after.columns == before.columns for before, after in stages[:-1])
    assert set(queries.QUERIES) <= set(contract.queries()) and corpus_pipeline.ORACLE_SQL is None


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_does_what_its_operator_says(stages):
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages
    assert ids(b) == ids(language.identify(a).filter("not rejected"))
    assert ids(c) == ids(exact_dedup.duplicates(b).filter("kept"))
    assert ids(d) == ids(simhash.near_duplicates(c).filter("doc_id = component_id"))
    taken = {r.doc_id: r.taken for r in mixture.mix(d).collect() if r.taken}
    words = {}
    for r in e.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall("[^\x20\x09-\x0d]+", r.text))
    assert words == taken
    assert f.agg({"n_words": "sum"}).first()[0] == sum(taken.values())


def test_clean_documents_stay(stages):
    (a, b), *_ = stages
    assert b.count() >= 0.98 * a.count()


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD + [(100 + i, f"the house and the garden number {i} of a street", "en", "a") for i in range(20)], clashing=True)
    extra = docs.columns[5:]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        if i < 4:
            values = [tuple(r)[5:] for r in docs.collect()]
            assert docs.columns[5:] == extra and values and set(values) == {("x",) * len(extra)}
    assert docs.count() > 0


def test_empty_table(spark):
    docs = documents(spark, [(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
    assert docs.count() == 0
