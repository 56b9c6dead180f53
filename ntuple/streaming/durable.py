"""A model that streams keep up to date: append-only deltas, merged on read, compacted on request.

The folder holds

* ``deltas/query=Q/batch=B``: signed counts that micro-batch ``B`` of the streaming query ``Q`` adds,
* ``base/version=V``: merged counts, and
* ``heads``: for each version, up to which batch of each query its base has taken the deltas.

A micro-batch writes its own changes only, whatever the size of the model.  A batch that is run
again replaces its own delta; a new query, with its own checkpoint, has deltas of its own, so it
continues the model instead of starting it anew.  A version counts once its heads are written, so
a compaction that fails leaves the model as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.address import BitSource, Mapping, tuple_rows
from ..operators.count_model import CountModel, Options, count_addresses

CELLS = "label string, ram_id int, address bigint, cnt bigint"
ROWS_OF_LABEL = -1
"""The tuple number under which the rows of a label are counted."""
INITIAL = "initial"


def changes(rows: DataFrame, mapping: Mapping, bits: BitSource, label: str = "label") -> DataFrame:
    """What training on ``rows`` adds: cells and, as tuple -1, the rows of each label."""
    cells = count_addresses(rows, mapping, bits, label).select("label", "ram_id", "address", "cnt")
    known = rows.where(F.col(label).isNotNull())
    sizes = known.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    return cells.unionByName(
        sizes.select("label", F.lit(ROWS_OF_LABEL).alias("ram_id"), F.lit(0).cast("bigint").alias("address"), "cnt")
    )


def negated(delta: DataFrame) -> DataFrame:
    """The changes that take ``delta`` back."""
    return delta.withColumn("cnt", -F.col("cnt"))


@dataclass(frozen=True)
class DurableModel:
    """A model folder.  Mapping and options belong to the caller, as for every model."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame | None:
        """A table of the folder, or None while nothing has been written there."""
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def start_from(self, model: CountModel) -> None:
        """Put the contents of an existing model into an empty folder."""
        cells = model.table.select("label", "ram_id", F.col("address").cast("bigint").alias("address"), "cnt")
        sizes = self.spark.createDataFrame(
            [(lab, ROWS_OF_LABEL, 0, n) for lab, n in model.trainings.items()], CELLS
        )
        self.append(INITIAL, 0, cells.unionByName(sizes))

    def append(self, query: str, batch: int, delta: DataFrame) -> None:
        """Write the changes of one micro-batch; writing them again replaces them."""
        if any(c in query for c in "/=%"):
            raise ValueError(f"a query name becomes a folder name: {query}")
        merged = delta.groupBy("label", "ram_id", "address").agg(F.sum("cnt").alias("cnt"))
        merged.write.mode("overwrite").parquet(f"{self.path}/deltas/query={query}/batch={batch}")

    def _heads(self) -> tuple[int, dict[str, int]]:
        """The last complete version and the last batch of each query in it."""
        heads = self._read("heads", "version bigint, query string, upto bigint")
        rows = [] if heads is None else heads.where(F.col("version") == heads.agg(F.max("version")).first()[0]).collect()
        return (rows[0]["version"], {r["query"]: r["upto"] for r in rows}) if rows else (-1, {})

    def _pending(self, heads: dict[str, int]) -> DataFrame | None:
        """Deltas that the base does not have yet; whole folders are skipped by their names."""
        deltas = self._read("deltas", f"{CELLS}, query string, batch bigint")
        if deltas is None:
            return None
        for query, upto in heads.items():
            deltas = deltas.where((F.col("query") != query) | (F.col("batch") > upto))
        return deltas

    def _merged(self, version: int, parts: list[DataFrame]) -> DataFrame:
        if version >= 0:
            parts = [*parts, self.spark.read.schema(CELLS).parquet(f"{self.path}/base/version={version}")]
        if not parts:
            return self.spark.createDataFrame([], CELLS)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        counts = out.groupBy("label", "ram_id", "address").agg(F.sum("cnt").alias("cnt"))
        return counts.where(F.col("cnt") != 0)

    def contents(self) -> DataFrame:
        """Base plus deltas: ``label``, ``ram_id`` (-1: rows), ``address``, ``cnt``."""
        version, heads = self._heads()
        pending = self._pending(heads)
        return self._merged(version, [] if pending is None else [pending.drop("query", "batch")])

    def compact(self) -> int:
        """Merge what has been written so far into a new base; returns its version."""
        version, heads = self._heads()
        pending = self._pending(heads)
        if pending is None:
            return version
        upto = {r["query"]: r["upto"] for r in pending.groupBy("query").agg(F.max("batch").alias("upto")).collect()}
        if not upto:
            return version
        # Batches that arrive meanwhile wait for the next compaction.
        taken = F.lit(False)
        for query, last in upto.items():
            taken |= (F.col("query") == query) & (F.col("batch") <= last)
        merged = self._merged(version, [pending.where(taken).drop("query", "batch")])
        merged.write.mode("overwrite").parquet(f"{self.path}/base/version={version + 1}")
        rows = [(version + 1, q, b) for q, b in (heads | upto).items()]
        heads_table = self.spark.createDataFrame(rows, "version bigint, query string, upto bigint")
        heads_table.coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
        return version + 1

    def model(self, mapping: Mapping, options: Options = Options()) -> CountModel:
        """The counting classifier that the folder holds now."""
        everything = self.contents()
        sizes = everything.where((F.col("ram_id") == ROWS_OF_LABEL) & (F.col("cnt") > 0)).collect()
        trainings = {r["label"]: r["cnt"] for r in sorted(sizes, key=lambda r: r["label"].encode())}
        return CountModel(everything.where((F.col("ram_id") >= 0) & (F.col("cnt") > 0)), mapping, trainings, options)


def train_durably(
    rows: DataFrame, mapping: Mapping, bits: BitSource, path: str, checkpoint: str, label: str = "label", compact_every: int = 0
):
    """Start a query that trains a model folder; returns the streaming query.

    The folder may hold a model already, of whatever query.  Every ``compact_every`` batches the
    deltas are merged.
    """
    spark = rows.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        folder = DurableModel(batch.sparkSession, path)
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        folder.append(query, batch_id, changes(batch, mapping, bits, label))
        if compact_every and (batch_id + 1) % compact_every == 0:
            folder.compact()

    return (
        rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class Expiring(StatefulProcessor):
    """Counts of a cell by event time; a count is taken back when its time leaves the window."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "ms bigint", "cnt bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total = 0
        now = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            for ms, n in part.groupby("ms")["cnt"].sum().items():
                due = int(ms) + self.window_ms
                if due <= now:
                    continue  # it came too late to be counted at all
                had = self.counts.getValue((int(ms),))[0] if self.counts.containsKey((int(ms),)) else 0
                self.counts.updateValue((int(ms),), (had + int(n),))
                self.handle.registerTimer(due)
                total += int(n)
        yield self._told(key, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = (expiredTimerInfo.getExpiryTimeInMs() - self.window_ms,)
        n = self.counts.getValue(ms)[0] if self.counts.containsKey(ms) else 0
        self.counts.removeKey(ms)
        yield self._told(key, -n)

    def _told(self, key, n: int) -> pd.DataFrame:
        return pd.DataFrame({"label": [key[0]], "ram_id": [key[1]], "address": [key[2]], "cnt": [n]})

    def close(self) -> None:
        pass


def forgetting_changes(
    rows: DataFrame, mapping: Mapping, bits: BitSource, ts: str, window_ms: int, late: str, label: str = "label"
) -> DataFrame:
    """Signed changes ``(label, ram_id, address, cnt)`` of a stream whose rows count for ``window_ms``.

    The state is one counter for each seen cell and event time (milliseconds) in the window, and a timer; once
    the watermark (``late`` behind the newest row) has passed the end of a row's time, its cells are taken back.
    Rows without label or time are left out.
    """
    labelled = rows.where(F.col(label).isNotNull() & F.col(ts).isNotNull()).withColumn(label, F.col(label).cast("string"))
    marked = labelled.withWatermark(ts, late)
    cells = tuple_rows(marked, mapping, bits, [label, ts], label=label).select(
        F.col(label).alias("label"), "ram_id", F.col("address").cast("bigint").alias("address"), F.col(ts).alias("ts"),
        F.unix_millis(F.col(ts)).alias("ms"), F.lit(1).cast("bigint").alias("cnt"),
    )
    return cells.groupBy("label", "ram_id", "address").transformWithStateInPandas(
        Expiring(window_ms), outputStructType=CELLS, outputMode="update", timeMode="eventTime"
    )


def train_forgetting(
    rows: DataFrame, mapping: Mapping, bits: BitSource, ts: str, window_ms: int, late: str, path: str, checkpoint: str, label: str = "label"
):
    """Start a query that keeps a model folder to the rows of the last ``window_ms``."""
    spark = rows.sparkSession

    def one(batch: DataFrame, batch_id: int) -> None:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        DurableModel(batch.sparkSession, path).append(query, batch_id, batch.select("label", "ram_id", "address", "cnt"))

    signed = forgetting_changes(rows, mapping, bits, ts, window_ms, late, label)
    return (
        signed.writeStream.foreachBatch(one)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
