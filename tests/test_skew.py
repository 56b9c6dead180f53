"""Joins with heavy keys, and ensembles whose parameters stay in tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ntuple.functions import joins
from ntuple.functions.hashing import h3_constants
from ntuple.operators import address, network


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_only_heavy_keys_are_listed(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b"))
    found = joins.heavy_keys(rows, ["a", "b"]).collect()
    hot = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"), F.lit("x"))).first()[0]
    assert [r["_h"] for r in found] == [hot] and 20 <= found[0]["_copies"] <= 23
    assert joins.heavy_keys(rows.limit(0), ["a"]).isEmpty()


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("row_keys", [["id"], None])
def test_a_third_of_the_rows_in_one_key_is_split(spark, many_partitions, how, row_keys):
    rows = spark.range(0, 60_000, 1, 24).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(7, 70)], "k long, v long"))
    got = joins.lookup_join(rows, table, ["k"], row_keys, how=how)
    want = rows.join(table, "k", how)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    hot = got.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) >= 8 and max(r["count"] for r in hot) < 10_000


def test_cold_keys_are_not_copied(spark, many_partitions):
    rows = spark.range(20_000).select("id", (F.col("id") % 5000).alias("k"))
    table = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    plan = joins.lookup_join(rows, table, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan


@pytest.fixture(scope="module")
def ensemble(spark):
    rng = random.Random(6)
    labels, layers = ["a", "b", "c"], []
    for size in (5, 4):
        mapping = address.padded_permutation(32, size, size)
        # Some slots are missing, some labels are not asked for.
        cells = [(lab, f, s, rng.uniform(-1, 1)) for lab in [*labels, "other"] for f in range(mapping.n_rams) for s in range(64) if rng.random() < 0.9]
        mask = [[rng.randrange(2) for _ in range(mapping.n_rams)] for _ in labels]
        bias = [rng.choice([0.0, 0.25, -1.5]) for _ in labels]
        layers.append((cells, mapping, h3_constants(size, 2, size), 64, mask, bias))
    rows = [(i, labels[i % 3], [rng.randrange(2) for _ in range(32)]) for i in range(40)]
    rows += [(100 + i, None if i < 5 else "a", rows[0][2]) for i in range(30)]
    return labels, layers, spark.createDataFrame(rows, "row_id bigint, label string, bits array<tinyint>")


def both_forms(spark, labels, layer, masked=True):
    cells, mapping, constants, slots, mask, bias = layer
    values = spark.createDataFrame(cells, "label string, filter int, slot int, value double")
    known = values.where(F.col("label").isin(labels))
    wide = network.BloomLayer.of(known, mapping, constants, slots, labels, mask if masked else None, bias)
    weights = spark.createDataFrame([(lab, f, w) for lab, row in zip(labels, mask, strict=True) for f, w in enumerate(row)], "label string, filter int, weight int")
    biases = spark.createDataFrame(list(zip(labels, bias, strict=True)), "label string, bias double")
    return wide, network.BloomTables(values, mapping, constants, slots, labels, weights if masked else None, biases)


@pytest.mark.parametrize("masked", [True, False])
def test_tables_answer_as_constants_do(spark, ensemble, monkeypatch, masked):
    labels, layers, df = ensemble
    forms = [both_forms(spark, labels, layer, masked) for layer in layers]
    want = network.ensemble_predict([w for w, _ in forms], df, "bits").select("row_id", "label", "bits", "predicted")
    expected = sorted(map(str, want.collect()))
    # No constant is built from the tables, so no limit holds for them.
    monkeypatch.setattr(network, "PARAMETER_LIMIT", 1)
    got = network.ensemble_tables_predict([t for _, t in forms], df, "bits")
    assert sorted(map(str, got.select("row_id", "label", "bits", "predicted").collect())) == expected
    place = df.dropDuplicates(["bits"]).select("row_id", "bits")
    mine = {r["row_id"]: r["logits"] for r in forms[0][1].logits(place, ["row_id"], "bits").collect()}
    assert mine == {r["row_id"]: r["s"] for r in place.select("row_id", forms[0][0].logits(F.col("bits")).alias("s")).collect()}


def test_pruning_scores_from_tables(spark, ensemble):
    labels, layers, df = ensemble
    wide, tables = both_forms(spark, labels, layers[0], False)
    for rows in (df, df.where("label is not null")):
        want = {tuple(r) for r in network.filter_scores(wide, rows, "bits", "label").collect()}
        assert {tuple(r) for r in tables.filter_scores(rows, "bits", "label").collect()} == want
