from compare import SMALL
from test_partenum import brute

import corpus_pipeline
from quire.llm import cuckoo
from quire.llm.workspace import materialize


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "byte_bpe"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SMALL), "stage"))
    languages, exact, near, mixed, last = tables[1:]
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert languages.count() >= 0.98 * docs.count()
    kept = {r.doc_id for r in cuckoo.exact_dedup(languages).filter("kept").collect()}
    assert {r.doc_id for r in exact.collect()} == kept
    found = brute([(r.doc_id, r.text) for r in exact.collect()])
    assert {r.doc_id for r in near.collect()} == {c for _, c in found.values()}
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) == {r.doc_id for r in near.collect()} and max(copies.values()) <= 2
    assert last.count() == mixed.count() and all(r.n_tokens > 0 and r.n_bytes > 0 for r in last.collect())


def test_rows_that_repeat_and_nulls(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(5)
    rows = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    out = corpus_pipeline.drop_exact_copies(spark, rows, SMALL)
    assert out.count() == docs.select("text").distinct().count() + 1


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], stage(spark, docs, SMALL).schema)
        assert docs.count() == 0
