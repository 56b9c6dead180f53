"""Online counterparts of training, forgetting, clustering and scoring on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.address import BitSource, Mapping, tuple_rows
from ..operators.cluster import Leaders, Rule, all_addresses, cluster_tuples
from ..operators.count_model import CountModel, count_addresses


def train_stream(rows: DataFrame, mapping: Mapping, bits: BitSource, label: str = "label") -> DataFrame:
    """Running model ``(label, ram_id, address, cnt)`` of a stream; use update or complete mode.

    State is one counter per seen address, partially combined before the shuffle.
    """
    return count_addresses(rows, mapping, bits, label)


def window_model(
    rows: DataFrame,
    mapping: Mapping,
    bits: BitSource,
    ts: str,
    size: str,
    slide: str,
    late: str,
    label: str = "label",
) -> DataFrame:
    """Forgetting: one model per sliding window; rows later than ``late`` are dropped."""
    marked = rows.withWatermark(ts, late) if rows.isStreaming else rows
    labelled = marked.where(F.col(label).isNotNull())
    keep = [ts, label]
    addressed = tuple_rows(labelled, mapping, bits, keep, label=label)
    return (
        addressed.groupBy(
            F.window(ts, size, slide).alias("window"), F.col(label).alias("label"), "ram_id", "address"
        )
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("window.start", "window.end", "label", "ram_id", "address", "cnt")
    )


def classify_stream(rows: DataFrame, model: CountModel, bits: BitSource) -> DataFrame:
    """Score a stream with a fixed model that fits a constant: a projection, stateless."""
    if not model.is_dense():
        raise ValueError("a model of this size is joined batch by batch: use classify_micro_batches")
    return model.classify(rows, bits)


def classify_micro_batches(
    rows: DataFrame, model: CountModel, bits: BitSource, sink: Callable[[DataFrame, int], None], checkpoint: str
):
    """Score a stream with a model of any size: each micro-batch is joined with the model table.

    ``sink`` gets the classified batch and its id; returns the streaming query.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        sink(model.classify(batch, bits), batch_id)

    return (
        rows.writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LeaderProcessor(StatefulProcessor):
    """Keeps the clusters of a group as state and emits the clusters each row trained."""

    def __init__(self, rule: Rule, n_rams: int):
        self.rule, self.n_rams = rule, n_rams

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState(
            "cells", "cluster int, ram_id int, address bigint", "cnt bigint, sum_y double"
        )
        self.sizes = handle.getMapState("sizes", "cluster int", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        leaders = Leaders(self.rule, self.n_rams)
        sizes = {k[0]: v[0] for k, v in self.sizes.iterator()}
        for c in range(len(sizes)):
            leaders.counts.append({})
            leaders.sums.append({})
            leaders.sizes.append(sizes[c])
        for (c, r, a), (n, s) in self.cells.iterator():
            leaders.counts[c][(r, a)] = n
            leaders.sums[c][(r, a)] = s
        before = [dict(c) for c in leaders.counts]
        batch = pd.concat(list(rows)).sort_values("ord")
        out = []
        for order, a, y in zip(batch["ord"], batch["a"], batch["y"], strict=True):
            for c in leaders.train(a, y):
                out.append((key[0], order, c))
        for c, cells in enumerate(leaders.counts):
            old = before[c] if c < len(before) else {}
            for cell, n in cells.items():
                if old.get(cell) != n:
                    self.cells.updateValue((c, *cell), (n, leaders.sums[c][cell]))
            self.sizes.updateValue((c,), (leaders.sizes[c],))
        yield pd.DataFrame(out, columns=["group", "ord", "cluster"])

    def close(self) -> None:
        pass


def cluster_stream(
    rows: DataFrame,
    bits: str,
    entry_size: int,
    tuple_size: int,
    seed: int,
    order: str,
    group: str,
    rule: Rule = Rule(),
) -> DataFrame:
    """Leader clustering with one state per group: ``(group, ord, cluster)`` assignments."""
    tuples = cluster_tuples(entry_size, tuple_size, rule.limit, seed)
    prepared = rows.select(
        F.col(group).cast("string").alias("group"),
        F.col(order).cast("bigint").alias("ord"),
        all_addresses(tuples, bits).alias("a"),
        F.lit(0.0).alias("y"),
    )
    return prepared.groupBy("group").transformWithStateInPandas(
        LeaderProcessor(rule, len(tuples["0"])),
        outputStructType="group string, ord bigint, cluster int",
        outputMode="append",
        timeMode="none",
    )
