"""Lookup joins that survive hot keys, and attaching small per-key tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
"""Largest proven size of a table that is sent to every executor."""
SALT = 8
"""Copies of a table of few rows, whose keys are not measured."""
PARTS = 64
"""A key with more than this part of the rows is heavy; its rows are split into such parts."""
SKETCHED = 10_000
"""Keys that the sketch of frequent keys follows; its counts are off by less than a part."""


def _heavy(rows: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """``_h`` (hash of the keys) and ``_copies`` for keys with more than one of :data:`PARTS` parts of the rows.

    One pass with a mergeable sketch, nothing is shuffled but the sketches; at most :data:`PARTS` keys result.
    """
    found = rows.select(F.xxhash64(*keys).alias("_h")).agg(
        F.expr(f"approx_top_k(_h, {PARTS}, {SKETCHED})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    row = found.first()
    part = max(row["n"] / PARTS, 1.0)
    listed = [(t["item"], min(PARTS, math.ceil(t["count"] / part))) for t in row["top"] or []]
    return [x for x in listed if x[1] > 1]


def heavy_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``_h`` and ``_copies`` of :func:`_heavy` as a table."""
    return rows.sparkSession.createDataFrame(_heavy(rows, keys), "_h bigint, _copies int")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    row_keys: list[str] | None = None,
    proven_bytes: int | None = None,
    how: str = "left",
    measure: bool = True,
) -> DataFrame:
    """Join rows with a table that is unique on ``keys``.

    The table is broadcast only when ``proven_bytes``, a bound that follows from parameters
    and not from data, is small.  Otherwise both sides shuffle on the keys.  Keys that a sketch of the
    rows finds heavy also shuffle on a salt, and only their entries of the table are copied, as often
    as their count asks for; all other keys stay as they are.  The salt is drawn from ``row_keys``, or,
    for rows without an identity, from the partition they are in.  A table of a few rows may be copied
    whole instead (``measure=False``).
    """
    if proven_bytes is not None and proven_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    of_row = F.xxhash64(*row_keys) if row_keys else F.spark_partition_id()
    if not measure:
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salted = rows.withColumn("_salt", F.pmod(of_row, F.lit(SALT)).cast("int"))
        return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
    salted, copies, salted_keys = dealt(rows, table, keys, row_keys)
    return salted.join(copies, salted_keys, how).drop("_salt")


def dealt(
    rows: DataFrame, table: DataFrame, keys: list[str], row_keys: list[str] | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and table with the keys by which they meet, no key of which has many rows: heavy keys get a salt."""
    of_row = F.xxhash64(*row_keys) if row_keys else F.spark_partition_id()
    found = _heavy(rows, keys)
    if not found:
        return rows, table, keys
    heavy = F.broadcast(rows.sparkSession.createDataFrame(found, "_h bigint, _copies int"))
    often = F.coalesce(F.col("_copies"), F.lit(1))
    salted = (
        rows.withColumn("_h", F.xxhash64(*keys))
        .join(heavy, "_h", "left")
        .withColumn("_salt", F.pmod(of_row, often).cast("int"))
        .drop("_h", "_copies")
    )
    copies = (
        table.withColumn("_h", F.xxhash64(*keys))
        .join(heavy, "_h", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), often - 1)))
        .drop("_h", "_copies")
    )
    return salted, copies, [*keys, "_salt"]


SMALL_ROWS = 250_000
"""Rows of a table that may be broadcast after they were counted."""


def broadcast_if_small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Send ``table`` to every executor if it was counted to be small; else leave the join to Spark."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Broadcast a driver-made table (one row per fitted key, a checked number) onto rows."""
    if keys:
        return df.join(F.broadcast(small), keys)
    one = F.lit(0)
    return df.withColumn("_one", one).join(F.broadcast(small.withColumn("_one", one)), "_one").drop("_one")
