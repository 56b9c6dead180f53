from __future__ import annotations

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from ntuple.operators import address, cluster, count_model, decide, encode, prep, regress
from ntuple.operators.address import BitColumn
from ntuple.operators.bloom import BloomModel, HashFamily
from ntuple.operators.count_model import CountModel, Options
from ntuple.operators.regress import RegressionModel
from ntuple.sources import blobs, store

BITS = BitColumn("bits")


def test_count_blob_golden(spark):
    text = (
        "AAAAAAAAAAACAAAA.AwAAAAAAAAACAAAA.AAAAAAAAAAACAAAA.AQAAAAAAAAACAAAA."
        "AgAAAAAAAAABAAAAAwAAAAAAAAABAAAA"
    )
    df = blobs.read_counts(spark.createDataFrame([(text,)], "blob string"))
    found = {(r["ram_id"], r["address"]): r["cnt"] for r in df.collect()}
    assert found == {(0, 0): 2, (1, 3): 2, (2, 0): 2, (3, 1): 2, (4, 2): 1, (4, 3): 1}
    assert blobs.lookup(df, 4).count() == 2 and blobs.lookup(df, 4, 3).first()["cnt"] == 1


def test_regression_blob_golden(spark):
    text = (
        "AgAAAAAAAAAAAAAAAAAAAAAAAAAAABBAAAAAAAAA8D8AAAAAAAAAAAAAAAAAAABALUMc6+I2Oj8AAAAAAAAAAAEAAAAAAAAAAAAAAAAAAEAAAAAAAAAAAAAAAAAAAPA/."
        "AgAAAAAAAADNzMzMzMwAQM3MzMzMzABAzczMzMzMAEAAAAAAAAAAAJqZmZmZmbk/mpmZmZmZuT+amZmZmZm5PwEAAAAAAAAAmpmZmZmZ8T+amZmZmZnxP5qZmZmZmfE/"
    )
    df = blobs.read_regression(spark.createDataFrame([(text,)], "blob string"))
    found = {(r["ram_id"], r["address"]): [r["cnt"], r["sum_y"], r["pending"]] for r in df.collect()}
    assert found == {
        (0, 0): [2.0, 0.0004, 0.0], (0, 1): [2.0, 0.0, 1.0], (0, 2): [0.0, 4.0, 1.0],
        (1, 0): [0.1] * 3, (1, 1): [1.1] * 3, (1, 2): [2.1] * 3,
    }


def packed(bits: str) -> str:
    pad = -len(bits) % 8
    full = bits + "0" * pad
    data = bytes([pad]) + bytes(int(full[i : i + 8], 2) for i in range(0, len(full), 8))
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("kind", ["C", "R", "U"])
def test_dataset_file(spark, tmp_path, kind):
    rows = [("111000000", "cold", 0.1), ("111100000", "cold", 0.2), ("000011111", "hot", 0.7)]
    parts = []
    for bits, label, y in rows:
        head = {"C": label.encode(), "R": struct.pack("<d", y), "U": b""}[kind]
        parts.append(base64.b64encode(head).decode() + "#" + packed(bits))
    (tmp_path / "rows.txt").write_text(f"{kind}$" + ".".join(parts))
    found = blobs.read_dataset(spark, str(tmp_path / "rows.txt")).collect()
    assert ["".join(map(str, r["bits"])) for r in found] == [r[0] for r in rows]
    if kind == "C":
        assert [r["label"] for r in found] == [r[1] for r in rows]
    else:
        assert [r["label"] for r in found] == [None] * 3
    assert [r["y"] for r in found] == ([r[2] for r in rows] if kind == "R" else [None] * 3)


def contents(df):
    return {tuple(r) for r in df.select(*sorted(df.columns)).collect()}


def test_count_model_round_trip(toy, tmp_path, spark):
    mapping = address.random_mapping(9, 3, 2, ["cold", "hot"])
    options = Options(balanced=True, weights={"cold": [1.0, 0.5, 1.0]}, negative_alpha=0.1)
    model = CountModel.train(toy, mapping, BITS, options=options, background=address.random_mapping(9, 3, 2))
    store.save_count_model(model, str(tmp_path / "m"))
    back = store.load_count_model(spark, str(tmp_path / "m"))
    assert contents(back.table) == contents(model.table)
    assert (back.mapping, back.trainings, back.options) == (mapping, model.trainings, options)
    assert contents(back.background) == contents(model.background)
    a = {r["row_id"]: r["scores"] for r in model.rank(toy, BITS).collect()}
    assert {r["row_id"]: r["scores"] for r in back.rank(toy, BITS).collect()} == a


def test_decision_rules_are_saved_by_name(toy, tmp_path, spark):
    mapping = address.random_mapping(9, 3, 2)
    named = decide.rule_named("fixed_threshold", b=2)
    for i, rule in enumerate((decide.best_margin, named, decide.rule_named("bleaching", confidence=2))):
        model = CountModel.train(toy, mapping, BITS, options=Options(rule=rule))
        store.save_count_model(model, str(tmp_path / f"m{i}"))
        back = store.load_count_model(spark, str(tmp_path / f"m{i}"))
        want = {r["row_id"]: r["scores"] for r in model.rank(toy, BITS).collect()}
        assert {r["row_id"]: r["scores"] for r in back.rank(toy, BITS).collect()} == want
    own = CountModel.train(toy, mapping, BITS, options=Options(rule=lambda v, n: decide.fixed_threshold(v, n, 1)))
    store.save_count_model(own, str(tmp_path / "own"))
    with pytest.raises(ValueError):
        store.load_count_model(spark, str(tmp_path / "own"))
    assert store.load_count_model(spark, str(tmp_path / "own"), named).options.rule == named
    with pytest.raises(ValueError):
        decide.rule_named("unheard of")
    bloom = BloomModel.train(toy, mapping, BITS, hashes=HashFamily("h3", 64, 2, 3), options=Options(balanced=True, rule=named))
    store.save_bloom_model(bloom, str(tmp_path / "bloom"))
    assert store.load_bloom_model(spark, str(tmp_path / "bloom")).options == bloom.options


def test_other_models_round_trip(toy, tmp_path, spark):
    bloom = BloomModel.train(toy, address.random_mapping(9, 3, 2), BITS, hashes=HashFamily("h3", 64, 2, 3))
    store.save_bloom_model(bloom, str(tmp_path / "b"))
    back = store.load_bloom_model(spark, str(tmp_path / "b"))
    assert contents(back.table) == contents(bloom.table) and back.hashes == bloom.hashes
    rows = toy.withColumn("y", F.col("row_id") / 10)
    reg = RegressionModel.train(rows, address.random_mapping(9, 3, 2), BITS, min_one=1)
    store.save_regression_model(reg, str(tmp_path / "r"))
    again = store.load_regression_model(spark, str(tmp_path / "r"), regress.ratio_mean)
    assert contents(again.table) == contents(reg.table) and again.min_one == 1
    clusters = cluster.train_rounds(toy, "bits", 9, 3, 1, "row_id", "label", rule=cluster.Rule(0.1, 10, 5))
    store.save_cluster_model(clusters, str(tmp_path / "c"))
    third = store.load_cluster_model(spark, str(tmp_path / "c"))
    assert third.sizes == clusters.sizes and third.rule == clusters.rule
    assert contents(third.table) == contents(clusters.table)
    encoder = encode.Thermometer.of([[0.1, 0.2], [1.0]])
    store.save_thermometer(encoder, spark, str(tmp_path / "t"))
    assert store.load_thermometer(spark, str(tmp_path / "t")) == encoder


def test_json_import(toy, tmp_path, spark):
    mapping = address.random_mapping(9, 3, 2, ["cold", "hot"])
    model = CountModel.train(toy, mapping, BITS)
    cells = {}
    for r in model.table.collect():
        cells.setdefault(r["label"], {}).setdefault(r["ram_id"], []).append((r["address"], r["cnt"]))
    classes = {
        lab: {
            "entrySize": 9,
            "count": model.trainings[lab],
            "mapping": [list(t) for t in mapping.of(lab)],
            "data": ".".join(
                base64.b64encode(b"".join(struct.pack("<Qi", a, n) for a, n in rams[r])).decode()
                for r in range(mapping.n_rams)
            ),
        }
        for lab, rams in cells.items()
    }
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"version": "x", "base": 2, "ignoreZero": False, "classes": classes}))
    back = store.read_classifier_json(spark, str(path))
    assert contents(back.table) == contents(model.table)
    assert back.mapping == mapping and back.trainings == model.trainings
    assert count_model.accuracy(back.classify(toy, BITS)).first()["accuracy"] == 1.0


def test_row_sink_and_sweep_resume(tmp_path, toy, spark):
    path = str(tmp_path / "rows")
    store.write_rows(toy, path)
    store.write_rows(toy, path)
    assert spark.read.parquet(path).count() == 18
    grid = spark.createDataFrame([("d", "h1", 1), ("d", "h2", 1), ("d", "h1", 2)], "dataset string, hp_id string, seed int")
    done = grid.where("hp_id = 'h1' and seed = 1").withColumn("test_acc", F.lit(0.5))
    prep.append_results(done, str(tmp_path / "results"))
    left = prep.pending_cells(grid, spark.read.parquet(str(tmp_path / "results")), ["dataset", "hp_id", "seed"])
    assert {tuple(r) for r in left.collect()} == {("d", "h2", 1), ("d", "h1", 2)}


def test_difference_is_empty_for_equal_tables(toy):
    model = CountModel.train(toy, address.random_mapping(9, 3, 2), BITS)
    keys = ["label", "ram_id", "address"]
    assert prep.difference(model.table, model.table, keys, ["cnt"]).count() == 0
    assert prep.difference(model.table, model.reset().table, keys, ["cnt"]).count() == model.table.count()
