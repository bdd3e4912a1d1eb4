"""The stages together, on the smallest tables."""

import pytest

pytest.importorskip("lodestate.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns
        docs = docs.persist()
        sizes.append(docs.count())
    assert sizes[0] >= 0.95 * first.count() and sizes == sorted(sizes, reverse=True)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
