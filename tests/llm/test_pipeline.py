import importlib

import pytest


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_are_the_contracted_ones(pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontaminate", "mix_sources"]


def test_each_stage_on_real_tables(pipeline, spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == names + ["copy"] * (k == 4)
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= 0.95 * counts[0] and counts[1] == counts[2] > counts[3] > counts[4]
    assert pipeline.run(spark, small).count() == counts[5]


def test_odd_rows_pass_every_stage(pipeline, spark, odd, empty, small):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in pipeline.STAGES:
            stage(spark, docs, small).count()
