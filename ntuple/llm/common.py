"""Helpers that the operators share: written tables, global running sums, words, seeded hashes."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space between words; every other character belongs to a word.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The files outlive executors, so what follows never recomputes what came before, and values
    that depend on the partitioning (partition numbers, row numbers) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ntuple-llm/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[str], weight: str | None, name: str = "before") -> DataFrame:
    """Store ``df`` and add the sum of ``weight`` (or the number) of the rows before each row.

    Rows are range-partitioned by ``order``; each partition is summed on its own and shifted by
    the total of the partitions before it, so no task sees more than its range.  ``order`` must
    tell apart the rows of any large group, else that group is one partition.  Only one row for
    each partition is broadcast.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    kept = stored(ranged.withColumn("_part", F.spark_partition_id()))
    own = F.col(weight) if weight else F.lit(1).cast("long")
    totals = kept.groupBy("_part").agg(F.sum(own).alias("_total"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_shift"))
    inside = (
        Window.partitionBy("_part")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        kept.withColumn("_in", F.coalesce(F.sum(own).over(inside), F.lit(0)))
        .join(F.broadcast(shifts), "_part")
        .withColumn(name, (F.col("_in") + F.col("_shift")).cast("long"))
        .drop("_part", "_in", "_shift")
    )


def count_words(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *parts: Column | str) -> Column:
    """32 hex digits that depend on the seed and the parts alone; SQL engines agree on them."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))


def hex_number(digits: Column, n: int = 7) -> Column:
    """The first ``n`` hex digits as a number."""
    return F.conv(F.substring(digits, 1, n), 16, 10).cast("long")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def sums_before(values: Column) -> Column:
    """The sum of the elements before each element of an array of integers.

    The array is summed in runs of about the root of its length, and the runs are shifted by the totals
    of the runs before them, so n elements cost about n to the power of 1.5, not the square.
    """
    none = F.array().cast("array<int>")

    def summed(part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(F.lit(0).alias("total"), none.alias("sums")),
            lambda done, n: F.struct(
                (done["total"] + n).alias("total"), F.concat(done["sums"], F.array(done["total"])).alias("sums")
            ),
        )

    def shifted(parts: Column) -> Column:
        shifts = summed(F.transform(parts, lambda p: p["total"]))["sums"]
        return F.flatten(F.zip_with(parts, shifts, lambda p, by: F.transform(p["sums"], lambda n: n + by)))

    def of(known: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(known))).cast("int")
        runs = F.sequence(F.lit(0), F.floor((F.size(known) - 1) / width).cast("int"))
        parts = F.transform(runs, lambda i: summed(F.slice(known, i * width + 1, width)))
        return F.when(F.size(known) == 0, none).otherwise(bound(parts, shifted))

    return bound(values, of)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it was counted to have at most ``rows`` rows; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def released() -> None:
    """Give the memory that a task has left back to the system; its worker serves other stages later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``chars`` characters each; a longer text stands alone."""
    begin = total = 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > chars:
            yield begin, i
            begin, total = i, 0
        total += len(text)
    if begin < len(texts):
        yield begin, len(texts)
