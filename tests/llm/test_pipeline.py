"""The pipeline's stages, each on what its predecessor kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import simhash, winnowing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns_and_decide(spark, docs):
    start = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == start.columns, name
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}")
        new = spark.read.parquet(path)
        assert new.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert 0 < new.count() <= docs.count()
        if name == "near_dedup":
            found = simhash.similar_documents(docs)
            assert {r[0] for r in new.select("doc_id").collect()} == {r[0] for r in found.select("component_id").distinct().collect()}
        if name == "decontaminate":
            assert winnowing.find_hits(new, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
        docs = new
    packed = cp.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run_equals_its_stages(spark):
    out = cp.run(spark, SF)
    assert {"bin_id", "doc_id", "piece", "start", "n_tokens"} == set(out.columns) and out.count() > 0


def test_stages_on_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", None, None), (None, "the cat and the dog", "en", "a", 3), (3, "the cat and the dog sat", "en", "a", 3), (3, "the cat and the dog sat", "en", "a", 3), (4, "", None, "b", 0)]
    for odd in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES[:-1]:
            assert stage(spark, odd, SF).select(F.count("*")).first()[0] <= odd.count()
        assert cp.STAGES[-1][1](spark, odd, SF).count() == odd.count()
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3] and sum(r.doc_id is None for r in kept) == 1
