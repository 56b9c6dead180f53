from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from ntuple.llm import queries as llm

#: Hashes, models or tokenizers that SQL does not have.
WITHOUT_SQL = {
    "op1_curve_packing",
    "op2_weighted_fingerprints",
    "op3_quality_rules",
    "op4_url_filter",
    "op6_secret_scan",
    "op8_kd_shards",
    "op13_simhash",
}


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(llm.QUERIES) - set(llm.ORACLES) == WITHOUT_SQL


def test_the_pipeline_keeps_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.count() > 0
    kept = corpus_pipeline.line_dedup(spark, docs, "")
    first = corpus_pipeline.near_join(spark, kept, "")
    mixed = corpus_pipeline.mix_sources(spark, first, "")
    assert kept.columns == first.columns == mixed.columns == docs.columns
    assert first.count() <= kept.count() <= docs.count()
    assert first.select("doc_id").distinct().count() == first.count()
