from __future__ import annotations

import __spark_entry__ as entry
from ntuple.plans import catalog

WITHOUT_SQL = {
    "search_thermometer",
    "train_clusters",
    "classify_clusters",
    "train_clusters_sequential",
    "predict_clustered_regression",
    "train_clusters_unsupervised",
    "classify_clusters_semi_supervised",
    "predict_order_clusters",
}


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == WITHOUT_SQL
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "label", "predicted"]
    assert df.count() > 0


def test_scoring_a_small_model_does_not_shuffle(spark):
    df = entry.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    # Only the spreading of the single small input file remains.
    assert all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_training_shuffles_combined_counts_once(spark):
    from ntuple.operators import address, count_model, encode

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        "label", "embedding"
    )
    bits = encode.fixed_thermometer(64, 2, -0.5, 0.5).on("embedding")
    table = count_model.count_addresses(rows, address.random_mapping(128, 8, 7), bits)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan
    assert "ReadSchema: struct<embedding:array<float>,label:int>" in plan


def test_large_models_split_hot_addresses(spark):
    """A third of the rows share one address; the salted join still gives every vote."""
    from pyspark.sql import functions as F

    from ntuple.operators import address
    from ntuple.operators.address import BitColumn
    from ntuple.operators.count_model import CountModel

    rows = spark.range(900).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"),
        F.transform(
            F.sequence(F.lit(0), F.lit(29)),
            lambda j: F.when(
                (F.col("id") % 3 != 0) & (F.pmod(F.xxhash64("id", j), F.lit(2)) == 1), 1
            ).otherwise(0).cast("tinyint"),
        ).alias("bits"),
    )
    model = CountModel.train(rows, address.ordered_mapping(30, 30), BitColumn("bits"))
    assert not model.is_dense()
    voted = model.votes(rows, BitColumn("bits"))
    assert voted.count() == 900
    hot = voted.where(F.col("row_id") % 3 == 0).select(F.col("votes")[0].alias("v")).distinct().collect()
    assert [r["v"] for r in hot] == [[150, 150]]
