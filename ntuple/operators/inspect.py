"""Looking into models: mental images, sizes, tuple weights, counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import bit, constant, let
from .address import SHARED, BitSource, Mapping, reverse_digit
from .count_model import CountModel


def mental_images(model: CountModel) -> DataFrame:
    """Per label and bit: how often the bit was set in training, by undoing the addresses.

    Equals the sum of counts over addresses whose digit at that bit is above zero; a bit
    that sits in several tuples adds up.  Zero-filled over the whole entry.
    """
    mapping = model.mapping
    spark = model.table.sparkSession
    plan = {key: [list(t) for t in tuples] for key, tuples in mapping.tuples.items()}
    if mapping.is_shared:
        tuples = constant(plan[SHARED], "array<array<int>>")
    else:
        keys = sorted(plan)
        tuples = F.element_at(
            constant([plan[k] for k in keys], "array<array<array<int>>>"),
            F.array_position(constant(keys, "array<string>"), F.col("label")).cast("int"),
        )
    cells = model.table.select(
        "label", "address", "cnt", F.posexplode(F.get(tuples, F.col("ram_id"))).alias("pos", "bit_index")
    )
    if mapping.is_wide:
        digit = F.substring("address", F.col("pos") + 1, F.lit(1)).cast("bigint")
    else:
        digit = reverse_digit(F.col("address"), F.col("pos"), mapping.base)
    seen = cells.where(digit > 0).groupBy("label", "bit_index").agg(F.sum("cnt").alias("intensity"))
    grid = spark.range(mapping.entry_size).select(
        F.col("id").cast("int").alias("bit_index"),
        F.explode(F.array(*[F.lit(lab) for lab in model.labels])).alias("label"),
    )
    return grid.join(seen, ["label", "bit_index"], "left").select(
        "label", "bit_index", F.coalesce("intensity", F.lit(0)).alias("intensity")
    )


def synthesize(image: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Bit rows drawn from an image ``(bit_index, intensity)``: level < intensity sets the bit.

    The level of row i is md5-uniform in [0, max - 1].  The image is one entry wide and
    becomes a constant of the plan.
    """
    spark = image.sparkSession
    cells = sorted((r["bit_index"], r["intensity"]) for r in image.select("bit_index", "intensity").collect())
    levels = constant([v for _, v in cells], "array<bigint>")
    top = max(v for _, v in cells)
    text = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    level = F.pmod(draw, F.lit(top)) if top > 0 else F.lit(0)
    return spark.range(n_rows).select(
        F.col("id").alias("row_id"),
        let(level, lambda d: F.transform(levels, lambda v: bit(d < v).cast("tinyint"))).alias("bits"),
    )


def entry_counts(table: DataFrame) -> DataFrame:
    """Tuples and distinct addresses per label."""
    return table.groupBy("label").agg(
        F.count_distinct("ram_id").alias("rams"), F.count(F.lit(1)).alias("entries")
    )


def deployed_bytes(model: CountModel) -> DataFrame:
    """Bytes of the stored addresses per label: ceil(tuple bits / 8) for each."""
    sizes = [
        (key, ram, -(-len(t) // 8))
        for key, tuples in model.mapping.tuples.items()
        for ram, t in enumerate(tuples)
    ]
    spark = model.table.sparkSession
    table = F.broadcast(spark.createDataFrame(sizes, "label string, ram_id int, width int"))
    keys = ["ram_id"] if model.mapping.is_shared else ["label", "ram_id"]
    if model.mapping.is_shared:
        table = table.drop("label")
    return model.table.join(table, keys).groupBy("label").agg(F.sum("width").alias("bytes"))


def fired(
    model: CountModel, df: DataFrame, bits: BitSource, label: str = "label", unlabelled: bool = False
) -> DataFrame:
    """Per discriminator, tuple and row label: rows whose vote is positive; ``unlabelled`` rows have a null label.

    Equal address patterns are counted first; the fan-out per pattern is tuples x labels,
    combined map-side to at most that many counters per row label.
    """
    # The outer forms give the same cells.  For the others Spark filters empty votes, and computes the
    # votes' inputs once more for it, down at the scan.
    rows = df if unlabelled else df.where(F.col(label).isNotNull())
    votes = model.votes_by_pattern(rows.withColumn("sample", F.col(label).cast("string")), bits, ["sample"])
    names = constant(model.labels, "array<string>")
    per_ram = votes.select("sample", "n", F.posexplode_outer("votes").alias("ram_id", "row"))
    cells = per_ram.select("sample", "n", "ram_id", F.posexplode_outer("row").alias("c", "vote"))
    return (
        cells.where(F.col("vote") > 0)
        .groupBy(F.get(names, F.col("c")).alias("label"), "ram_id", "sample")
        .agg(F.sum("n").alias("n"))
    )


def ram_weights(
    model: CountModel, df: DataFrame, bits: BitSource, metric: str = "entropy", label: str = "label",
    unlabelled: bool = False,
) -> DataFrame:
    """Weight of every tuple of every label in [0, 1]: ``(label, ram_id, weight)``.

    ``entropy`` is 1 minus the normalised entropy of the classes it fires for,
    ``information_gain`` the information of firing about the class (over the classes that
    fired), ``purity`` the share of its own class.  Divided by the best tuple of the label.
    With ``unlabelled`` rows without a label count as rows of one more class.
    """
    counts = fired(model, df, bits, label, unlabelled)
    by_ram = W.partitionBy("label", "ram_id")
    n, total = F.col("n"), F.sum("n").over(by_ram)
    classes = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("string").alias("sample"))
        .agg(F.count(F.lit(1)).alias("class_n"))
    )
    if metric == "entropy":
        parts = counts.select("label", "ram_id", (n / total).alias("p"))
        top = math.log2(len(model.labels)) if len(model.labels) > 1 else 1.0
        raw = parts.groupBy("label", "ram_id").agg(
            (1.0 + F.sum(F.col("p") * F.log2("p")) / F.lit(top)).alias("w")
        )
    elif metric == "purity":
        own = F.when(F.col("sample") == F.col("label"), n).otherwise(F.lit(0))
        raw = counts.groupBy("label", "ram_id").agg((F.sum(own) / F.sum("n")).alias("w"))
    elif metric == "information_gain":
        size = sum(model_counts(classes).values())
        parts = counts.join(F.broadcast(classes), "sample").select(
            "label", "ram_id", "n", "class_n", total.alias("total")
        )
        fire, cls = F.col("total") / size, F.col("class_n") / size
        joint, miss = F.col("n") / size, (F.col("class_n") - F.col("n")) / size
        quiet = 1.0 - fire

        def part(p: Column, q: Column) -> Column:
            return F.when((p > 0) & (q > 0), p * F.log2(p / (q * cls))).otherwise(F.lit(0.0))

        raw = parts.select(
            "label", "ram_id", (part(joint, fire) + part(miss, quiet)).alias("w")
        ).groupBy("label", "ram_id").agg(F.sum("w").alias("w"))
    else:
        raise ValueError(f"unknown metric {metric}")
    spark = df.sparkSession
    grid = spark.range(model.mapping.n_rams).select(
        F.col("id").cast("int").alias("ram_id"),
        F.explode(F.array(*[F.lit(lab) for lab in model.labels])).alias("label"),
    )
    full = grid.join(raw, ["label", "ram_id"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    best = F.max("w").over(W.partitionBy("label"))
    return full.select(
        "label", "ram_id", F.when(best > 0, F.col("w") / best).otherwise(F.col("w")).alias("weight")
    )


def model_counts(classes: DataFrame) -> dict[str, int]:
    return {r["sample"]: r["class_n"] for r in classes.collect()}


def weights_from_table(table: DataFrame) -> dict[str, list[float]]:
    found: dict[str, dict[int, float]] = {}
    for r in table.select("label", "ram_id", "weight").toLocalIterator():
        found.setdefault(r[0], {})[r[1]] = r[2]
    return {lab: [w[i] for i in sorted(w)] for lab, w in found.items()}


def weights_table(weights: dict[str, list[float]], spark) -> DataFrame:
    rows = [(lab, i, float(w)) for lab, ws in weights.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, "label string, ram_id int, weight double")


def prune_weights(table: DataFrame, threshold: float) -> DataFrame:
    """Silence tuples whose weight is below the threshold."""
    return table.withColumn(
        "weight", F.when(F.col("weight") < threshold, F.lit(0.0)).otherwise(F.col("weight"))
    )


def mapping_sizes(mapping: Mapping, spark) -> DataFrame:
    return mapping.table(spark).groupBy("label", "ram_id").agg(F.count(F.lit(1)).alias("tuple_size"))


def configuration(model: CountModel) -> DataFrame:
    """Settings of a model as ``(setting, value)`` rows."""
    mapping, o = model.mapping, model.options
    values = {
        "entry_size": mapping.entry_size,
        "tuples": mapping.n_rams,
        "widest_tuple": mapping.widest,
        "base": mapping.base,
        "shared_mapping": mapping.is_shared,
        "labels": len(model.labels),
        "trained_rows": sum(model.trainings.values()),
        "ignore_zero": o.ignore_zero,
        "balanced": o.balanced,
    }
    rows = [(k, str(v).lower()) for k, v in values.items()]
    return model.table.sparkSession.createDataFrame(rows, "setting string, value string")
