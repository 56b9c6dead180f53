"""Queries over documents, some of which have an empty text and so no letter share."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ntuple.operators import address, count_model, encode, inspect, tune
from ntuple.plans import catalog, tables

from .compare import compare

EMPTY = (60, 61, 62)
"""Only the first of them has a label in ``documents_some_labelled``."""
NO_TEXT = 63


def write(spark, folder: str, more_labels: list[tuple]) -> str:
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "c1", "def", "7", "gh!"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    docs = [(i, t, len(t)) for i, t in enumerate(texts)] + [(i, "", 0) for i in EMPTY] + [(NO_TEXT, None, None)]
    labels = [(i, int(len(texts[i]) > 1500), 0) for i in range(0, 60, 2)] + more_labels
    spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def documents_unlabelled(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("unlabelled")), [])


@pytest.fixture(scope="module")
def documents_some_labelled(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("some")), [(EMPTY[0], 1, 0)])


@pytest.fixture(scope="module")
def documents_null_label(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("null")), [(1, None, None)])


def same_as_sql(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    _, n, same, note = compare(spark, con, folder, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert same and n, note


def test_documents_without_text(spark, documents_unlabelled):
    rows = tables.documents(spark, documents_unlabelled, labelled=False).collect()
    x = {r["row_id"]: r["x"] for r in rows}
    assert len(x) == 64
    assert all(x[i][0] == 0 and math.isnan(x[i][1]) and x[i][2:] == [1, 1] for i in EMPTY)
    assert x[NO_TEXT] == [None] * 4


def test_fits_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame(
        [(x,) for x in ([1.0, 5.0], [float("nan"), 6.0], [3.0, None], [float("inf"), 7.0])], "x array<double>"
    )
    assert encode.fit_linear(df.select(encode.finite("x").alias("x")), "x", 1).thresholds == ((2.0,), (6.0,))


def test_semi_supervised_clusters_take_every_document(spark, documents_unlabelled):
    found = catalog.QUERIES["classify_clusters_semi_supervised"](spark, documents_unlabelled)
    rows = found.where(F.col("predicted").isin("0", "1") & (F.col("predicted_cluster") >= 0)).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(64))


@pytest.mark.parametrize("odd", [float("nan"), float("inf"), 1.5e308])
def test_candidates_of_values_above_every_threshold(spark, odd):
    rng = random.Random(4)
    rows = [(i, "a" if i % 3 == 0 else "b", [odd if i % 3 == 0 else rng.random() / 2, rng.random()]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, x array<double>")
    train, check = df.where("row_id < 30"), df.where("row_id >= 30")
    encoder = encode.fixed_thermometer(2, 3)
    mapping = address.explicit_mapping(6, ((1, 3), (1, 4), (1, 5)))
    candidates = [0.2, 0.6]
    found = tune.candidate_accuracy(train, check, encoder, mapping, ["a", "b"], "x", "label", "row_id", (0, 1), candidates)
    for c, t in enumerate(candidates):
        bits = encoder.replaced(0, 1, t).on("x")
        model = count_model.CountModel.train(train, mapping, bits)
        assert found[c] == model.classify(check, bits).where("predicted = label").count()


def test_threshold_search_over_documents(spark, documents_some_labelled):
    found = catalog.QUERIES["search_thermometer"](spark, documents_some_labelled).collect()
    assert sorted((r["feature"], r["k"]) for r in found) == [(f, k) for f in range(4) for k in range(2)]
    assert all(math.isfinite(r["threshold"]) and 0 <= r["accuracy"] <= 1 for r in found)


def test_pseudo_labels_of_documents_without_text(spark, documents_unlabelled, documents_some_labelled):
    for folder in (documents_unlabelled, documents_some_labelled):
        same_as_sql(spark, folder, "pseudo_labels")


@pytest.mark.parametrize("metric", ["entropy", "information_gain", "pruned", "purity"])
def test_tuple_weights_of_documents_without_text(
    spark, documents_unlabelled, documents_some_labelled, documents_null_label, metric
):
    for folder in (documents_unlabelled, documents_some_labelled, documents_null_label):
        same_as_sql(spark, folder, f"tuple_weights_{metric}")


def test_weights_read_the_features_of_labelled_rows_only(spark, documents_unlabelled):
    docs = tables.documents(spark, documents_unlabelled)
    bits = encode.fixed_thermometer(4, 2).on("x")
    model = count_model.CountModel.train(docs, address.random_mapping(8, 4, 1), bits)
    plan = inspect.fired(model, docs, bits)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("transform" in line for line in scans)
