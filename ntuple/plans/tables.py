"""Inputs of the registered queries: the given tables brought into row form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import let, quotient


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores although the input has fewer splits than there are.

    A file with one row group is read by one task, and everything up to the first shuffle
    would run in it.  Tables with many splits, as any large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, label, x)``: 64 features per embedding, 10 labels."""
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def documents(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """``(row_id, label, x)``: length, letter share, distinct-word share, words; label = quality.

    An empty text has no letter share: it is NaN, above every threshold.
    """
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    words = F.split("text", " ")
    # Features before the join, which may shuffle its rows: texts stay where they are read.
    features = docs.select(
        "doc_id",
        let(
            words,
            lambda w: F.array(
                F.col("n_chars").cast("double"),
                quotient(F.length(F.regexp_replace("text", "[^A-Za-z]", "")), F.col("n_chars")),
                F.size(F.array_distinct(w)) / F.size(w),
                F.size(w).cast("double"),
            ),
        ).alias("x"),
    )
    return features.join(labels, "doc_id", "inner" if labelled else "left").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("label"), "x"
    )


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(label, x)``: quantity, price, discount, tax; label = return flag and line status."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("x"),
    )
    return spread(rows)


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, ts, user_id, label, value, hour)``; hour of day with minutes as a fraction."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return spread(events).select(
        F.col("event_id").alias("row_id"),
        "ts",
        "user_id",
        F.col("event_type").alias("label"),
        "value",
        ((F.hour("ts") * 60 + F.minute("ts")) / F.lit(60.0)).alias("hour"),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, y, x)``: regression of the order price on customer, month and priority."""
    priority = F.substring("o_orderpriority", 1, 1).cast("double")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    return spread(orders).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("y"),
        F.array(
            F.col("o_custkey").cast("double"),
            F.month("o_orderdate").cast("double"),
            F.dayofmonth("o_orderdate").cast("double"),
            F.coalesce(priority, F.lit(0.0)),
        ).alias("x"),
    )


def pixels(spark: SparkSession, sf_dir: str, side: int = 4) -> DataFrame:
    """``(image_id, row, col, r, g, b)``: one small image per part, colours from md5."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("p")
    grid = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), cells)
    digest = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.col("p").cast("string")))
    shade = [F.conv(F.substring(digest, 1 + 2 * k, 2), 16, 10).cast("double") / 255 for k in range(3)]
    return grid.select(
        "image_id",
        F.floor(F.col("p") / side).cast("int").alias("row"),
        (F.col("p") % side).cast("int").alias("col"),
        shade[0].alias("r"),
        shade[1].alias("g"),
        shade[2].alias("b"),
    )
