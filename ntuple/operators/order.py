"""Exact order statistics, rank bins and global ranks by range partitioning.

Rows are range-partitioned by ``(key, value, tie)`` on a sample of the table, sorted inside their
partition and written once.  The place of a row in its partition, less the place of the first row
of its key there, plus the rows of the key in the partitions before, is its rank: the only other
tables are the counts for each partition and key.  No key or value has to fit one task: a unique
tie-break cuts runs of equal values, and where there is none equal values are counted first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import attach, broadcast_if_small
from ..session import cut_lineage

BIN_ROWS = 1_000_000
"""Rows that one task puts in order."""
PLACE_BITS = 33
"""Low bits of a generated row number: the place in the partition."""


@dataclass(frozen=True)
class OrderStatistic:
    value: float
    below: int
    """How many values of the key are smaller than ``value``."""


def _offsets(placed: DataFrame, keys: list[str], first, size) -> DataFrame:
    """``keys``, ``_part``, ``_first``, ``_size``, ``_before``, ``_all``: a row for each partition and key."""
    own = placed.groupBy(*keys, "_part").agg(F.min(first).alias("_first"), F.sum(size).alias("_size"))
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return own.withColumns(
        {"_before": F.coalesce(F.sum("_size").over(ahead), F.lit(0)), "_all": F.sum("_size").over(W.partitionBy(*keys))}
    )


def ranked(df: DataFrame, keys: list[str], value: str, tie: str, name: str, total: str | None = None) -> DataFrame:
    """Add the 0-based rank of each row by ``(value, tie)`` in its key, and the rows of the key.

    ``tie`` must be unique in its key.  The rows are shuffled once.
    """
    order = [*keys, value, tie]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    rows = cut_lineage(rows).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    placed = cut_lineage(_offsets(rows, keys, F.col("_place"), F.lit(1)))
    # Null keys are keys as well.
    named = placed.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), "_first", "_before", "_all"
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= rows[k].eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(broadcast_if_small(named), same & (rows["_part"] == F.col("_p")))
    more = [] if total is None else [F.col("_all").alias(total)]
    return joined.withColumn(name, F.col("_place") - F.col("_first") + F.col("_before")).select(*df.columns, name, *more)


def _cumulated(rows: DataFrame) -> DataFrame:
    """Add ``_upto``, the running sum of ``_n`` in the partition, in the order of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            upto = total + np.cumsum(batch.column("_n").to_numpy())
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, pa.int64())], names=[*batch.schema.names, "_upto"])

    return rows.mapInArrow(run, rows.withColumn("_upto", F.lit(0).cast("bigint")).schema)


def _found(rows: DataFrame, wanted: dict[int, tuple[np.ndarray, np.ndarray]]) -> list:
    """``(i, _v, _from)`` of the asked places; ``wanted``: partition -> sorted places, their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, n, upto = (c.to_numpy() for c in batch.columns)
            out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for p in np.unique(part):
                places, numbers = wanted.get(int(p), (None, None))
                if places is None:
                    continue
                own = np.flatnonzero(part == p)
                own = own[np.argsort(upto[own], kind="stable")]
                at = np.searchsorted(upto[own], places, side="right")
                inside = at < len(own)
                row = own[at[inside]]
                hit = upto[row] - n[row] <= places[inside]
                row = row[hit]
                out.append((numbers[inside][hit], value[row], upto[row] - n[row]))
            arrays = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "value", "start"])

    some = rows.where(F.col("_part").isin([int(p) for p in wanted])) if len(wanted) < 100 else rows
    return some.select("_part", "_v", "_n", "_upto").mapInArrow(run, "i bigint, value double, start bigint").collect()


def order_statistics(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: Callable[[tuple, int], list[int]],
) -> dict[tuple, list[OrderStatistic]]:
    """The values at 0-based ``ranks(key, count)`` of every key, exactly.

    The result, and with it the number of keys and of ranks, is for the driver.  Equal values of a
    key are counted before they are put in order.
    """
    spark = df.sparkSession
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    order = [*keys, "_v"]
    sorted_ = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(_cumulated(sorted_))
    offsets = cut_lineage(_offsets(placed, keys, F.col("_upto") - F.col("_n"), F.col("_n")))
    totals = offsets.where("_before = 0").select(*keys, "_all").collect()
    sizes = {tuple(r[k] for k in keys): r["_all"] for r in totals}
    wanted = {key: list(ranks(key, n)) for key, n in sizes.items()}
    for key, rs in wanted.items():
        if any(not 0 <= r < sizes[key] for r in rs):
            raise ValueError(f"a rank is outside a key of {sizes[key]} values")
    asked = [(*key, r) for key, rs in wanted.items() for r in sorted(set(rs))]
    if not asked:
        return {key: [] for key in wanted}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    targets = spark.createDataFrame(
        [(i, *t) for i, t in enumerate(asked)],
        ", ".join(["_i bigint", *[f"_k{i} {types[k]}" for i, k in enumerate(keys)], "_rank bigint"]),
    )
    same = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
    for i, k in enumerate(keys):
        same &= offsets[k].eqNullSafe(F.col(f"_k{i}"))
    at = offsets.join(F.broadcast(targets), same).select(
        "_i", "_part", (F.col("_rank") - F.col("_before") + F.col("_first")).alias("place"), (F.col("_before") - F.col("_first")).alias("shift")
    ).collect()
    of_part = defaultdict(list)
    for r in at:
        of_part[r["_part"]].append((r["place"], r["_i"]))
    places = {p: tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(found), strict=True)) for p, found in of_part.items()}
    shift = {r["_i"]: r["shift"] for r in at}
    done = {asked[r["i"]]: OrderStatistic(r["value"], r["start"] + shift[r["i"]]) for r in _found(placed, places)}
    return {key: [done[(*key, r)] for r in rs] for key, rs in wanted.items()}


def rank_bins(df: DataFrame, keys: list[str], value: str, tie: str, n_bins: int, name: str = "bin") -> DataFrame:
    """Add the equal-frequency bin ``(rank * n_bins) div count`` of each row.

    Rows are ranked by ``(value, tie)`` within their key, so a run of equal values is cut where a bin ends.
    """
    found = ranked(df, keys, value, tie, "_rank", "_total")
    return found.withColumn(name, F.expr(f"cast(_rank * {n_bins} div _total as int)")).drop("_rank", "_total")


def global_ranks(
    df: DataFrame, keys: list[str], value: str, tie: str, n_bins: int | None = None, name: str = "rank"
) -> DataFrame:
    """0-based rank of each row by ``(value, tie)`` in its key, and its bin of equal size.

    Without ``n_bins`` a bin has about ``BIN_ROWS`` rows, whatever the size of the table.
    """
    n_bins = n_bins or 1 + df.count() // BIN_ROWS
    found = ranked(df, keys, value, tie, name, "_total")
    return found.withColumn(f"{name}_bin", F.expr(f"cast({name} * {n_bins} div _total as int)")).drop("_total")


def smallest_share(
    df: DataFrame, keys: list[str], order: str, keep: Callable[[tuple, int], int], name: str
) -> DataFrame:
    """Flag the ``keep(key, count)`` rows with the smallest unique ``order`` number per key.

    A cut value per key is found by :func:`order_statistics`; flagging is then one map-side
    comparison, so a key may hold any share of the table.
    """
    spark = df.sparkSession
    counts: dict[tuple, int] = {}

    def last(key: tuple, n: int) -> list[int]:
        counts[key] = keep(key, n)
        return [counts[key] - 1] if 0 < counts[key] <= n else []

    cut = order_statistics(df, keys, order, last)
    key_type = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(*key, stats[0].value if stats else None) for key, stats in cut.items()]
    schema = ", ".join([f"{k} {key_type[k]}" for k in keys] + ["_cut double"])
    return attach(df, spark.createDataFrame(rows, schema), keys).withColumn(
        name, F.coalesce(F.col(order).cast("double") <= F.col("_cut"), F.lit(False))
    ).drop("_cut")
