"""Models as folders of Parquet tables, datasets as Parquet, and import of JSON models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide
from ..operators.address import Mapping
from ..operators.bloom import BloomModel, HashFamily
from ..operators.cluster import ClusterModel, Rule
from ..operators.count_model import CountModel, Options
from ..operators.encode import Thermometer
from ..operators.regress import RegressionModel
from . import blobs


def write_rows(df: DataFrame, path: str, mode: str = "append") -> None:
    """Dataset sink."""
    df.write.mode(mode).parquet(path)


def _meta(spark: SparkSession, path: str, values: dict) -> None:
    rows = [(k, json.dumps(v)) for k, v in values.items()]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/meta"
    )


def read_meta(spark: SparkSession, path: str) -> dict:
    return {r["key"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/meta").collect()}


def _mapping_meta(mapping: Mapping) -> dict:
    return {
        "entry_size": mapping.entry_size,
        "base": mapping.base,
        "multi_resolution": mapping.multi_resolution,
    }


def _load_mapping(spark: SparkSession, path: str, meta: dict) -> Mapping:
    return Mapping.from_table(
        spark.read.parquet(f"{path}/mapping"), meta["entry_size"], meta["base"], meta["multi_resolution"]
    )


def save_count_model(model: CountModel, path: str) -> None:
    """Contents partitioned by label; mapping, options and weights alongside."""
    spark = model.table.sparkSession
    model.table.write.mode("overwrite").partitionBy("label").parquet(f"{path}/ram")
    model.mapping.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/mapping")
    shared = model.background_mapping
    if model.background is not None:
        model.background.write.mode("overwrite").parquet(f"{path}/background")
        shared = shared or model.mapping
        shared.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/background_mapping")
    _meta(
        spark,
        path,
        {
            **_mapping_meta(model.mapping),
            "trainings": model.trainings,
            "options": _options_meta(model.options),
            "background": None if model.background is None else _mapping_meta(shared),
        },
    )


def _options_meta(o: Options) -> dict:
    """Everything between votes and scores; a rule that is code of its own has no name."""
    return {
        "ignore_zero": o.ignore_zero,
        "balanced": o.balanced,
        "weights": o.weights,
        "attention": o.attention,
        "cross_class": o.cross_class,
        "rule": decide.name_of(o.rule),
        "soft": o.soft,
        "background_beta": o.background_beta,
        "negative_alpha": o.negative_alpha,
        "negative_mode": o.negative_mode,
    }


def _load_options(meta: dict, rule) -> Options:
    if rule is None and meta["rule"] is None:
        raise ValueError("the model was saved with a decision rule of its own code: pass rule=")
    if rule is None:
        name, parameters = meta["rule"]
        plain = decide.RULES.get(name)
        rule = plain if plain is not None and not parameters else decide.rule_named(name, **parameters)
    return Options(**{**meta, "rule": rule})


def load_count_model(spark: SparkSession, path: str, rule=None) -> CountModel:
    """A decision rule that is code of its own is passed again; named ones come from the folder."""
    meta = read_meta(spark, path)
    options = _load_options(meta["options"], rule)
    table = spark.read.schema("ram_id int, address bigint, cnt bigint, label string").parquet(f"{path}/ram")
    mapping = _load_mapping(spark, path, meta)
    if mapping.is_wide:
        table = spark.read.schema("ram_id int, address string, cnt bigint, label string").parquet(f"{path}/ram")
    if meta["background"] is None:
        return CountModel(table, mapping, meta["trainings"], options)
    m = meta["background"]
    shared = Mapping.from_table(
        spark.read.parquet(f"{path}/background_mapping"), m["entry_size"], m["base"], m["multi_resolution"]
    )
    background = spark.read.parquet(f"{path}/background")
    return CountModel(table, mapping, meta["trainings"], options, background, shared)


def save_bloom_model(model: BloomModel, path: str) -> None:
    spark = model.table.sparkSession
    model.table.write.mode("overwrite").partitionBy("label").parquet(f"{path}/ram")
    model.mapping.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/mapping")
    h = model.hashes
    _meta(
        spark,
        path,
        {
            **_mapping_meta(model.mapping),
            "trainings": model.trainings,
            "ignore_zero": model.ignore_zero,
            "options": _options_meta(model.options),
            "hashes": {"mode": h.mode, "n_slots": h.n_slots, "n_hashes": h.n_hashes, "seed": h.seed},
        },
    )


def load_bloom_model(spark: SparkSession, path: str, rule=None) -> BloomModel:
    meta = read_meta(spark, path)
    table = spark.read.schema("ram_id int, slot int, cnt bigint, label string").parquet(f"{path}/ram")
    return BloomModel(
        table,
        _load_mapping(spark, path, meta),
        meta["trainings"],
        HashFamily(**meta["hashes"]),
        meta["ignore_zero"],
        _load_options(meta["options"], rule),
    )


def save_regression_model(model: RegressionModel, path: str) -> None:
    spark = model.table.sparkSession
    model.table.write.mode("overwrite").parquet(f"{path}/ram")
    model.mapping.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/mapping")
    _meta(
        spark,
        path,
        {**_mapping_meta(model.mapping), "min_zero": model.min_zero, "min_one": model.min_one},
    )


def load_regression_model(spark: SparkSession, path: str, mean) -> RegressionModel:
    meta = read_meta(spark, path)
    return RegressionModel(
        spark.read.parquet(f"{path}/ram"),
        _load_mapping(spark, path, meta),
        mean,
        meta["min_zero"],
        meta["min_one"],
    )


def save_cluster_model(model: ClusterModel, path: str) -> None:
    spark = model.table.sparkSession
    model.table.write.mode("overwrite").parquet(f"{path}/ram")
    model.counts.write.mode("overwrite").parquet(f"{path}/counts")
    Mapping(model.entry_size, model.tuples).table(spark).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/mapping"
    )
    _meta(
        spark,
        path,
        {
            "entry_size": model.entry_size,
            "base": 2,
            "multi_resolution": False,
            "rule": [model.rule.min_score, model.rule.threshold, model.rule.limit],
        },
    )


def load_cluster_model(spark: SparkSession, path: str) -> ClusterModel:
    meta = read_meta(spark, path)
    return ClusterModel(
        spark.read.parquet(f"{path}/ram"),
        spark.read.parquet(f"{path}/counts"),
        dict(_load_mapping(spark, path, meta).tuples),
        meta["entry_size"],
        Rule(*meta["rule"]),
    )


def save_thermometer(encoder: Thermometer, spark: SparkSession, path: str) -> None:
    encoder.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_thermometer(spark: SparkSession, path: str) -> Thermometer:
    return Thermometer.from_table(spark.read.parquet(path))


# -- JSON models ------------------------------------------------------------

CLASSIFIER_JSON = (
    "base int, ignoreZero boolean, classes map<string, "
    "struct<entrySize: int, count: bigint, mapping: array<array<int>>, data: string>>"
)
"""Fixed field names of the JSON form: per class its tuples, row count and contents blob."""


def read_classifier_json(spark: SparkSession, path: str) -> CountModel:
    """Import a classifier saved as JSON."""
    document = spark.read.schema(CLASSIFIER_JSON).json(path, multiLine=True)
    classes = document.select("base", "ignoreZero", F.explode("classes").alias("label", "c")).select(
        "base", "ignoreZero", "label", "c.*"
    )
    heads = classes.drop("data").collect()
    mapping = Mapping(
        heads[0]["entrySize"],
        {r["label"]: tuple(tuple(t) for t in r["mapping"]) for r in heads},
        heads[0]["base"] or 2,
    )
    contents = blobs.read_counts(classes, "data", ["label"])
    trainings = {r["label"]: r["count"] for r in sorted(heads, key=lambda r: r["label"].encode())}
    return CountModel(contents, mapping, trainings, Options(ignore_zero=bool(heads[0]["ignoreZero"])))
