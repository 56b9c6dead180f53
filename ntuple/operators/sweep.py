"""Training and scoring many configurations in one job: the model is a part of every key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from . import decide
from .address import BitSource, Mapping, class_counts, tuple_rows


def grid_mapping(grid: dict[str, Mapping]) -> Mapping:
    """The shared mappings of a grid as one mapping whose labels are the configurations."""
    first = next(iter(grid.values()))
    if any(m.entry_size != first.entry_size or not m.is_shared for m in grid.values()):
        raise ValueError("the configurations of a sweep share their bits and one mapping for all labels")
    return Mapping(first.entry_size, {name: m.of("") for name, m in grid.items()}, first.base)


def train_grid(rows: DataFrame, grid: dict[str, Mapping], bits: BitSource, label: str = "label") -> DataFrame:
    """``(model_id, label, ram_id, address, cnt)`` of every configuration, counted in one pass over the rows."""
    known = rows.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    cells = tuple_rows(known, grid_mapping(grid), bits, [label], model_label="model_id")
    return cells.groupBy("model_id", F.col(label).alias("label"), "ram_id", "address").agg(F.count(F.lit(1)).alias("cnt"))


def classify_grid(
    model: DataFrame,
    labels: list[str],
    rows: DataFrame,
    grid: dict[str, Mapping],
    bits: BitSource,
    row_id: str,
    label: str = "label",
    rule: Callable = decide.bleaching,
) -> DataFrame:
    """``(model_id, row_id, label, predicted)`` of every row under every configuration.

    One join of all addresses with the counts of all models; an entry that many rows and tuples ask for is
    split.  ``row_id`` is unique; ``labels`` are in byte-wise order.
    """
    counts = [F.coalesce(F.sum(F.when(F.col("label") == lab, F.col("cnt"))), F.lit(0)).alias(f"_c{i}") for i, lab in enumerate(labels)]
    own = model.groupBy("model_id", "ram_id", "address").agg(*counts).select(
        "model_id", "ram_id", "address", F.array(*[F.col(f"_c{i}") for i in range(len(labels))]).alias("_v")
    )
    asked = tuple_rows(rows, grid_mapping(grid), bits, [row_id, label], model_label="model_id")
    met = lookup_join(asked, own, ["model_id", "ram_id", "address"], [row_id, "ram_id"])
    none = F.array_repeat(F.lit(0).cast("bigint"), len(labels))
    entry = F.struct("ram_id", F.coalesce("_v", none).alias("v"))
    voted = met.groupBy("model_id", row_id, label).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias("votes"))
    predicted = decide.winner(rule(F.col("votes"), len(labels)), labels)
    return voted.select("model_id", row_id, F.col(label).cast("string").alias("label"), predicted.alias("predicted"))


def sweep(
    train: DataFrame,
    test: DataFrame,
    grid: dict[str, Mapping],
    bits: BitSource,
    row_id: str,
    label: str = "label",
    rule: Callable = decide.bleaching,
) -> DataFrame:
    """``(model_id, entries, rows, hits, test_acc)`` of each configuration, trained on one table and tested on another.

    Test rows without label count for nothing; a configuration is listed if it has test rows.
    """
    model = train_grid(train, grid, bits, label)
    known = test.where(F.col(label).isNotNull())
    judged = classify_grid(model, list(class_counts(train, label)), known, grid, bits, row_id, label, rule)
    hit = F.when(F.col("predicted") == F.col("label"), 1).otherwise(0)
    scores = judged.groupBy("model_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(hit).alias("hits"))
    entries = model.groupBy("model_id").agg(F.count(F.lit(1)).alias("entries"))
    return entries.join(scores, "model_id").select(
        "model_id", "entries", "rows", "hits", (F.col("hits") / F.col("rows")).alias("test_acc")
    )
