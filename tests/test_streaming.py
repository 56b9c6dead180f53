from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ntuple.operators import address, cluster
from ntuple.operators.address import BitColumn
from ntuple.operators.count_model import CountModel
from ntuple.streaming import durable, online

from . import brute
from .conftest import make_rows

BITS = BitColumn("bits")
SCHEMA = "row_id bigint, bits array<tinyint>, label string, y double, ts timestamp"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three files of rows, one per batch."""
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = make_rows(60, 18, 21)
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 600 + 1_700_000_000))
    for i in range(3):
        part = df.where((F.col("row_id") >= 20 * i) & (F.col("row_id") < 20 * i + 20))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return df.sparkSession.table(name)


def contents(df):
    return {tuple(r) for r in df.select("label", "ram_id", "address", "cnt").collect()}


def test_continuous_training_equals_batch(spark, folder):
    path, _ = folder
    mapping = address.random_mapping(18, 4, 3)
    batch = CountModel.train(spark.read.parquet(path), mapping, BITS)
    live = run(online.train_stream(stream(spark, path), mapping, BITS), "live_model", "complete")
    assert contents(live) == contents(batch.table)


def ended(query):
    query.awaitTermination(300)
    assert query.exception() is None


def test_a_durable_model_goes_on_from_any_state(spark, folder, tmp_path):
    """An existing model, a stream, a new checkpoint, a repeated batch and compactions between them."""
    path, _ = folder
    mapping = address.random_mapping(18, 4, 3)
    rows = spark.read.parquet(path)
    first = CountModel.train(rows.where("row_id < 30"), mapping, BITS)
    kept = durable.DurableModel(spark, str(tmp_path / "model"))
    assert kept.contents().count() == 0 and kept.compact() == -1
    kept.start_from(first)
    assert contents(kept.model(mapping).table) == contents(first.table)
    ended(durable.train_durably(stream(spark, path), mapping, BITS, kept.path, str(tmp_path / "ck1"), compact_every=2))
    ended(durable.train_durably(stream(spark, path), mapping, BITS, kept.path, str(tmp_path / "ck2")))
    want = first.add(rows, BITS).add(rows, BITS)
    got = kept.model(mapping)
    assert contents(got.table) == contents(want.table) and got.trainings == want.trainings
    # A batch that runs again replaces itself, before and after it is part of the base.
    more = durable.changes(rows.where("row_id >= 40"), mapping, BITS)
    kept.append("again", 0, more)
    kept.append("again", 0, more)
    want = want.add(rows.where("row_id >= 40"), BITS)
    assert contents(kept.model(mapping).table) == contents(want.table)
    version = kept.compact()
    kept.append("again", 0, more)
    assert contents(kept.model(mapping).table) == contents(want.table)
    # Forgetting is a delta like any other.
    kept.append("again", 1, durable.negated(durable.changes(rows.where("row_id < 30"), mapping, BITS)))
    want = want.remove(rows.where("row_id < 30"), BITS)
    assert kept.compact() == version + 1
    got = kept.model(mapping)
    assert contents(got.table) == contents(want.table) and got.trainings == want.trainings
    assert {tuple(r) for r in got.classify(rows, BITS).select("row_id", "predicted").collect()} == {
        tuple(r) for r in want.classify(rows, BITS).select("row_id", "predicted").collect()
    }


def test_a_forgetting_model_equals_train_minus_untrain(spark, folder, tmp_path):
    path, rows = folder
    mapping = address.random_mapping(18, 4, 3)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        window = 4 * 3600 * 1000
        ended(durable.train_forgetting(
            stream(spark, path), mapping, BITS, "ts", window, "10 minutes", str(tmp_path / "model"), str(tmp_path / "ck")
        ))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    everything = spark.read.parquet(path)
    # The newest row is 59 x 600 s after the first; the watermark is 600 s behind it.
    gone = everything.where(F.unix_millis("ts") + window <= F.lit((58 * 600 + 1_700_000_000) * 1000))
    assert 0 < gone.count() < 60
    want = CountModel.train(everything, mapping, BITS).remove(gone, BITS)
    assert contents(durable.DurableModel(spark, str(tmp_path / "model")).contents()) == contents(want.table)


def test_window_models_equal_batch(spark, folder):
    path, _ = folder
    mapping = address.random_mapping(18, 4, 3)
    args = (mapping, BITS, "ts", "2 hours", "1 hour", "1 hour")
    batch = online.window_model(spark.read.parquet(path), *args)
    live = run(online.window_model(stream(spark, path), *args), "windows", "complete")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in batch.collect()}


def test_stream_scoring_equals_batch(spark, folder):
    path, _ = folder
    model = CountModel.train(spark.read.parquet(path), address.random_mapping(18, 4, 3), BITS)
    batch = model.classify(spark.read.parquet(path), BITS)
    live = run(online.classify_stream(stream(spark, path), model, BITS).select("row_id", "predicted"), "scored", "append")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in batch.select("row_id", "predicted").collect()}


def test_stream_clusters_equal_row_by_row(spark, folder):
    path, rows = folder
    rule = cluster.Rule(0.4, 6.0, 3)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        out = online.cluster_stream(stream(spark, path), "bits", 18, 5, 4, "row_id", "label", rule)
        live = run(out, "clusters", "append")
        tuples = cluster.cluster_tuples(18, 5, rule.limit, 4)
        expected = set()
        for lab in "abc":
            mine = [(i, bits) for i, bits, g, _ in rows if g == lab]
            assigned, _ = brute.leaders([(b, 0.0) for _, b in mine], [tuples[str(c)] for c in range(3)], rule)
            expected |= {(lab, i, c) for (i, _), fits in zip(mine, assigned, strict=True) for c in fits}
        assert {tuple(r) for r in live.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
