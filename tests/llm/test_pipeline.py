import corpus_pipeline
import pytest
from textloom.llm import shared


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = shared.save(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        assert docs.columns == columns and docs.count()
        assert docs.count() <= before or name.startswith("mixing")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    total = {r.doc_id: r.doc_tokens for r in rows.collect()}
    assert set(total) == {r.doc_id for r in docs.collect()}


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_take_nulls_ties_and_clashing_names(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    rows = stage(spark, docs, "/root/testdata/sf0.001")
    assert rows.columns == docs.columns
    kept = {r.doc_id: r for r in rows.collect()}
    before = {r.doc_id: r for r in docs.collect()}
    assert set(kept) <= set(before)
    for key, r in kept.items():
        assert r.digest == before[key].digest and r.n_removed == before[key].n_removed
        assert name == "substring dedup" or r.text == before[key].text
    if name == "substring dedup":
        assert rows.count() == 12 and "p0" not in kept[5].text and kept[3].text is None and kept[8].text == before[8].text
    if name == "SimHash near-dedup":
        # 3 and 4 are empty, 1 and 2 differ by case, 1 comes twice, 5 and 6 share most shingles
        assert sorted((x for x in kept if x), key=int) == [1, 3, 5, 7, 8, 9, 10]


def test_packing_stage_takes_nulls(spark, docs):
    rows = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in docs.collect()}
