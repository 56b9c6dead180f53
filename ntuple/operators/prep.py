"""Row preparation, splits, grids and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .encode import feature_statistics
from .order import smallest_share


def shuffle_number(seed: int, *keys: Column | str) -> Column:
    """A reproducible 48-bit number per row from the md5 of seed and key."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def split_rows(df: DataFrame, row_id: str, share: float, seed: int, at_least: int = 1) -> DataFrame:
    """Add ``is_validation``: the ``int(share * n)`` rows (one at least) first in md5 order."""
    numbered = df.withColumn("_u", shuffle_number(seed, row_id))
    return smallest_share(
        numbered, [], "_u", lambda _key, n: max(at_least, int(share * n)), "is_validation"
    ).drop("_u")


def stratified_split(df: DataFrame, row_id: str, label: str, share: float, seed: int) -> DataFrame:
    """Add ``is_test``: ``int(share * n)`` rows of every label."""
    numbered = df.withColumn("_u", shuffle_number(seed, row_id))
    return smallest_share(
        numbered, [label], "_u", lambda _key, n: int(share * n), "is_test"
    ).drop("_u")


def stratified_cap(df: DataFrame, row_id: str, label: str, size: int, seed: int) -> DataFrame:
    """A sample of about ``size`` rows with the label shares of the whole (sampling operator).

    Each label keeps ``int(size * n_label / n)`` rows; all rows when the table is smaller.
    """
    total = df.count()
    if total <= size:
        return df
    numbered = df.withColumn("_u", shuffle_number(seed, row_id))
    return (
        smallest_share(numbered, [label], "_u", lambda _key, n: n * size // total, "_kept")
        .where(F.col("_kept"))
        .drop("_u", "_kept")
    )


def without_nan(df: DataFrame, features: str) -> DataFrame:
    """Rows whose features are all numbers."""
    return df.where(~F.exists(features, lambda x: x.isNull() | F.isnan(x)))


def min_max_scaled(train: DataFrame, df: DataFrame, features: str) -> DataFrame:
    """Scale features of ``df`` by the training minimum and range (flat features by 1)."""
    from ..functions.expr import constant

    stats = constant(
        [{"a": s["min"], "r": (s["max"] - s["min"]) or 1.0} for s in feature_statistics(train, features)],
        "array<struct<a:double,r:double>>",
    )
    return df.withColumn(
        features, F.zip_with(features, stats, lambda x, s: (x.cast("double") - s["a"]) / s["r"])
    )


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric coercion; what is no number becomes the mean of its column."""
    coerced = df
    for c in columns:
        coerced = coerced.withColumn(c, F.col(c).try_cast("double"))
    means = coerced.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return coerced.select(
        *[
            F.coalesce(F.col(c), F.lit(means[c])).alias(c) if c in columns else F.col(c)
            for c in coerced.columns
        ]
    )


def supervision(df: DataFrame) -> DataFrame:
    """What a dataset ``(label, y)`` can be used for."""
    n, labels, targets = F.count(F.lit(1)), F.count("label"), F.count("y")
    return df.agg(
        n.alias("n_rows"),
        labels.alias("n_labels"),
        targets.alias("n_targets"),
        F.when(labels + targets == 0, "unsupervised")
        .when(labels + targets < n, "semi_supervised")
        .otherwise("supervised")
        .alias("kind"),
        F.when(targets > 0, "regression").when(labels > 0, "classification").otherwise("none").alias("task"),
    )


def replace_rows(df: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``updates`` take the place of rows with the same keys, and new ones are added."""
    return df.join(updates.select(*keys), keys, "left_anti").unionByName(updates)


def difference(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Entries that differ between two keyed tables; empty exactly when they are equal."""
    left = a.select(*keys, F.struct(*values).alias("a"))
    right = b.select(*keys, F.struct(*values).alias("b"))
    return left.join(right, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


# -- sweeps -----------------------------------------------------------------


def pending_cells(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells without a result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def best_configuration(results: DataFrame) -> DataFrame:
    """Per dataset the configuration with the best mean accuracy over seeds."""
    means = results.groupBy("dataset", "hp_id").agg(
        F.avg("test_acc").alias("mean_acc"), F.count(F.lit(1)).alias("runs")
    )
    order = W.partitionBy("dataset").orderBy(F.desc("mean_acc"), "hp_id")
    return means.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def run_summary(results: DataFrame) -> DataFrame:
    """Mean and deviation over runs, and how many seeds were covered."""
    return results.groupBy("dataset", "hp_id").agg(
        F.avg("test_acc").alias("mean_acc"),
        F.coalesce(F.stddev_samp("test_acc"), F.lit(0.0)).alias("std_acc"),
        F.count_distinct("seed").alias("seeds"),
    )


def against_published(best: DataFrame, published: DataFrame, limit: float = 0.05) -> DataFrame:
    """Published figures next to ours; ``flag`` marks gaps beyond ``limit``."""
    gap = F.col("mean_acc") - F.col("paper_acc")
    return published.join(best, "dataset", "left").select(
        "dataset", "paper_acc", "mean_acc", gap.alias("gap"), (F.abs(gap) > limit).alias("flag")
    )
