"""Leader clustering over tuple memories, per label or per any group column.

A row trains every cluster of its group that is similar enough; when none is, it opens a
new cluster, or trains the most similar one once the group has ``limit`` clusters.  The rule
depends on row order.  ``train_rounds`` applies it to slices of the order: all rows of a
slice are scored against the model of the previous round by joins, so one group may hold
any share of the table; a slice of one row is the row-by-row rule.  ``train_sequential`` is
the row-by-row rule itself with one ordered task per group and a checked group size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import constant, let
from ..functions.scalars import seeded_order
from ..functions.joins import dealt, lookup_join
from ..session import cut_lineage
from .address import BitColumn, Mapping, random_mapping, slot_count, slot_offsets, tuple_addresses
from .count_model import DENSE_CELLS, CountModel, Options
from .order import order_statistics
from .regress import RegressionModel, by_arrays

SEPARATOR = "::"
ROW_BYTES = 96
"""Generous size of one row of a cluster table in memory."""
GROUP_ROWS = 1_000_000
"""Most rows of one group that the row-by-row mode accepts."""
GROUP_CELLS = 1 << 12
"""Most cells of a group that are looked through as one row."""
PATTERNS = 100_000
"""Patterns of bits that a task of the row-by-row mode remembers."""
ROWS_AT_ONCE = 100_000
"""Rows of whole groups that the row-by-row mode takes at a time."""
SLICE_ROWS = 5_000
"""Rows of a slice for each task of a round."""
LANES = 8
"""Fewest groups that are worth a step together."""
CELLS_IN_STEP = 1 << 22
"""Cells of the groups that are trained in step."""
CELLS_AT_ONCE = 100_000
"""Cells of groups that are done, which it hands on together."""


@dataclass(frozen=True)
class Rule:
    min_score: float = 0.1
    threshold: float = 10.0
    limit: int = 5

    def needed(self, count: Column) -> Column:
        return F.least(F.lit(1.0), F.lit(self.min_score) + count / F.lit(self.threshold))


@dataclass(frozen=True)
class ClusterModel:
    """``table`` is ``(label, cluster, ram_id, address, cnt, sum_y)``, ``counts`` is
    ``(label, cluster, n)``.  Groups may be many (users, devices), so both stay tables."""

    table: DataFrame
    counts: DataFrame
    tuples: dict[str, tuple]
    entry_size: int
    rule: Rule

    @cached_property
    def sizes(self) -> dict[tuple[str, int], int]:
        """Rows per cluster on the driver, a row for each cluster, for models whose groups are class
        labels; ``counts`` is the same as a table."""
        rows = self.counts.collect()
        return {(r["label"], r["cluster"]): r["n"] for r in rows}

    @property
    def clusters(self) -> list[tuple[str, int]]:
        return sorted(self.sizes)

    def with_rule(self, **changes) -> ClusterModel:
        """Other scores and limits for the next training call."""
        return replace(self, rule=replace(self.rule, **changes))

    def as_count_model(self, options: Options = Options()) -> CountModel:
        """Every cluster as a class named ``label::cluster``."""
        names = [f"{lab}{SEPARATOR}{c}" for lab, c in self.clusters]
        trainings = {
            f"{lab}{SEPARATOR}{c}": n
            for (lab, c), n in sorted(
                self.sizes.items(), key=lambda kv: f"{kv[0][0]}{SEPARATOR}{kv[0][1]}".encode()
            )
        }
        mapping = Mapping(self.entry_size, {n: self.tuples[n.rsplit(SEPARATOR, 1)[1]] for n in names})
        table = self.table.select(
            F.concat_ws(SEPARATOR, "label", F.col("cluster").cast("string")).alias("label"),
            "ram_id",
            "address",
            "cnt",
        )
        return CountModel(table, mapping, trainings, options)

    def classify(self, df: DataFrame, bits: str) -> DataFrame:
        """Add ``votes``, ``predicted`` and ``predicted_cluster``.

        Every cluster is a class, so a row has many votes: if all cells fit a constant, it is decided as arrays.
        """
        model = self.as_count_model()
        if model.labels and model.is_dense():
            return self._decided(model, df, bits)
        out = model.classify(df, BitColumn(bits))
        parts = F.split("predicted", SEPARATOR)
        return out.withColumn("predicted_cluster", F.element_at(parts, -1).cast("int")).withColumn(
            "predicted", F.array_join(F.slice(parts, 1, F.size(parts) - 1), SEPARATOR)
        )

    def _decided(self, model: CountModel, df: DataFrame, bits: str) -> DataFrame:
        judge = VoteJudge(model, self.tuples)
        rest = [c for c in df.columns if c not in ("votes", "predicted", "predicted_cluster")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                won = judge.winners(batch.column(rest.index(bits)))
                more = [pa.array(judge.labels, pa.string()).take(won), pa.array(judge.clusters, pa.int32()).take(won)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*rest, "predicted", "predicted_cluster"])

        rows = df.select(*rest)
        schema = rows.withColumns({"predicted": F.lit(""), "predicted_cluster": F.lit(0)}).schema
        # The votes are computed only where they are asked for.
        out = model.votes(rows.mapInArrow(run, schema), BitColumn(bits))
        return out.select(*rest, "votes", "predicted", "predicted_cluster")

    def similarities(self, df: DataFrame, bits: str, row_id: str) -> DataFrame:
        """Score of every cluster for every row: ``(row_id, label, cluster, score)``."""
        fan = constant(
            [{"l": lab, "c": c} for lab, c in self.clusters], "array<struct<l:string,c:int>>"
        )
        rows = df.select(row_id, bits, F.explode(fan).alias("_k")).select(
            row_id, bits, F.col("_k.l").alias("label"), F.col("_k.c").alias("cluster")
        )
        return _scored(rows, self.table, self.tuples, bits, [row_id, "label", "cluster"])

    def predict(self, df: DataFrame, bits: str, row_id: str, mean, group: str | None = None) -> DataFrame:
        """Regression: the prediction of the most similar cluster, 0 when none is similar.

        ``group`` names the column with the group of a row; without it there is one group.  Rows of many
        groups seldom repeat: where a group has few possible cells and the mean has a form for arrays, they
        are sorted to the cells of their group and judged there.  Else equal rows are one pattern.
        """
        key = F.col(group).cast("string") if group else F.lit("")
        rows = df.select(row_id, key.alias("label"), _pattern(bits))
        of_votes = by_arrays(mean)
        if group and of_votes and self._cells <= GROUP_CELLS:
            return self._judged(rows, row_id, of_votes)
        patterns = rows.select("label", "_bits").distinct()
        per = self._votes(patterns).groupBy("label", "_bits", "cluster").agg(
            _similarity().alias("score"), mean(F.col("cnt"), F.col("sum_y")).alias("value")
        )
        best = per.groupBy("label", "_bits").agg(
            F.max_by(
                F.struct("score", "value"), F.struct("score", (-F.col("cluster")).alias("o"))
            ).alias("b")
        )
        found = cut_lineage(best.select(
            "label",
            "_bits",
            F.when(F.col("b.score") > 0, F.col("b.value")).otherwise(F.lit(0.0)).alias("prediction"),
        ))
        size = found.count() * (ROW_BYTES + self.entry_size)
        return lookup_join(rows, found, ["label", "_bits"], [row_id], size, how="inner").select(row_id, "prediction")

    @property
    def _cells(self) -> int:
        """Possible cells of a group."""
        return sum(1 << len(t) for group in self.tuples.values() for t in group)

    def _places(self) -> tuple[list[list[dict]], Column]:
        """For each tuple of each cluster the first of its cells among those of a group and the weights of its
        bits; and the place of a row of the table."""
        first, plan = 0, []
        for _, group in sorted(self.tuples.items(), key=lambda kv: int(kv[0])):
            plan.append([])
            for tup in group:
                plan[-1].append({"o": first, "p": [{"i": i, "w": 1 << j} for j, i in enumerate(tup)]})
                first += 1 << len(tup)
        offsets = constant([[e["o"] for e in own] for own in plan], "array<array<bigint>>")
        return plan, F.get(F.get(offsets, F.col("cluster")), F.col("ram_id")) + F.col("address")

    def _judged(self, rows: DataFrame, row_id: str, of_votes) -> DataFrame:
        """``(row_id, prediction)`` of rows ``(row_id, label, _bits)``, each judged beside the cells of its group.

        The cells of a group are one row, which comes before the rows of the group; those of a heavy group
        come before each of its parts.
        """
        plan, place = self._places()
        entry = F.struct(place.alias("k"), F.col("cnt").alias("cnt"), F.col("sum_y").alias("sum_y"))
        packed = self.table.groupBy("label").agg(
            F.array_sort(F.collect_list(entry)).alias("_e"), (F.max("cluster") + 1).alias("_n")
        )
        salted, copies, keys = dealt(rows, packed, ["label"], [row_id])
        both = copies.select(*keys, "_n", "_e.k", "_e.cnt", "_e.sum_y").unionByName(
            salted.select(*keys, row_id, F.transform("_bits", lambda b: b.cast("tinyint")).alias("_bits")), True
        )
        # A given number of partitions is not merged by size.
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        beside = both.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("_n").isNull())
        judge = GroupJudge(plan, of_votes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            for batch in batches:
                known, own, values = judge.of(batch, known)
                yield pa.RecordBatch.from_arrays([batch.column(row_id).take(own), pa.array(values)], names=[row_id, "prediction"])

        schema = rows.select(row_id, F.lit(0.0).alias("prediction")).schema
        return beside.select("label", "_n", "k", "cnt", "sum_y", row_id, "_bits").mapInArrow(run, schema)

    def _votes(self, patterns: DataFrame) -> DataFrame:
        """``(label, _bits, cluster, ram_id, cnt, sum_y)`` of patterns ``(label, _bits)``, a row for each tuple of
        their group's clusters.

        If a group has few possible cells, all of them are one row, which patterns meet by their group; else
        every address is looked up for itself.
        """
        if self._cells > GROUP_CELLS:
            fanned = _own_clusters(patterns, self.counts, ["_bits"], "_bits")
            return _looked_up(fanned, self.table, self.tuples, "_bits", ["_bits", "label", "cluster"])
        plan, slot = self._places()
        places = constant(
            [{"c": c, "r": r} | e for c, own in enumerate(plan) for r, e in enumerate(own)],
            "array<struct<c:int,r:int,o:bigint,p:array<struct<i:int,w:bigint>>>>",
        )
        packed = self.table.groupBy("label").agg(
            F.map_from_entries(F.collect_list(F.struct(slot.alias("k"), F.struct("cnt", "sum_y").alias("v")))).alias("_cells"),
            F.max("cluster").alias("_last"),
        )

        def vote(e: Column) -> Column:
            place = F.aggregate(
                e["p"], e["o"], lambda acc, p: acc + F.coalesce(F.get("_bits", p["i"]).cast("bigint") * p["w"], F.lit(0))
            )
            return F.struct(e["c"].alias("cluster"), e["r"].alias("ram_id"), F.element_at("_cells", place).alias("v"))

        met = lookup_join(patterns, packed, ["label"], ["_bits"], how="inner")
        own = F.filter(places, lambda e: e["c"] <= F.col("_last"))
        votes = met.select("label", "_bits", F.explode(F.transform(own, vote)).alias("_v"))
        return votes.select(
            "label",
            "_bits",
            "_v.cluster",
            "_v.ram_id",
            F.coalesce("_v.v.cnt", F.lit(0)).alias("cnt"),
            F.coalesce("_v.v.sum_y", F.lit(0.0)).alias("sum_y"),
        )


def bit_matrix(bits: pa.Array, width: int, exact: bool = False) -> np.ndarray:
    """The first ``width`` bits of lists as rows of equal length; missing ones are zero, or with ``exact`` an error."""
    sizes = pc.fill_null(pc.list_value_length(bits), 0).to_numpy(zero_copy_only=False)
    values = bits.flatten()
    if exact and ((sizes < width).any() or values.null_count):
        raise ValueError("a row has fewer bits than the mapping refers to")
    values = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), width), values.dtype)
    out[row[column < width], column[column < width]] = values[column < width]
    return out


def bleached(votes: np.ndarray) -> np.ndarray:
    """Scores ``(row, label)`` of votes ``(row, tuple, label)``: :func:`decide.bleaching` over arrays."""

    def ambiguous(scores: np.ndarray) -> np.ndarray:
        top = scores.max(axis=1)
        return (top > 1) & ((scores == top[:, None]).sum(axis=1) > 1)

    out = (votes > 0).sum(axis=1)
    rows = np.flatnonzero(ambiguous(out))
    above = np.zeros(len(rows), votes.dtype)
    while len(rows):
        own = votes[rows]
        above = np.where(own > above[:, None, None], own, np.iinfo(votes.dtype).max).min(axis=(1, 2))
        scores = (own > above[:, None, None]).sum(axis=1)
        out[rows] = scores
        left = ambiguous(scores)
        rows, above = rows[left], above[left]
    return out


class VoteJudge:
    """Classes by bleached votes from the cells of all clusters (a task-side helper)."""

    VOTES = 1 << 20

    def __init__(self, model: CountModel, tuples: dict[str, tuple]):
        parts = [name.rsplit(SEPARATOR, 1) for name in model.labels]
        self.labels, self.clusters = [lab for lab, _ in parts], [int(c) for _, c in parts]
        self.tuples = {int(c): [(list(t), [1 << j for j in range(len(t))]) for t in own] for c, own in tuples.items()}
        self.width = max((i for c in set(self.clusters) for at, _ in self.tuples[c] for i in at), default=-1) + 1
        offsets = slot_offsets(model.mapping, model.labels)
        n_rams = model.mapping.n_rams
        self.first = np.array([[offsets[name, r] for r in range(n_rams)] for name in model.labels])
        self.cells = np.zeros(slot_count(model.mapping, model.labels), np.int64)
        place = {name: i for i, name in enumerate(model.labels)}
        found = model.table.where(F.col("label").isin(model.labels)).select("label", "ram_id", "address", "cnt").toArrow()
        label = np.array([place[name] for name in found["label"].to_pylist()], np.int64)
        self.cells[self.first[label, found["ram_id"].to_numpy()] + found["address"].to_numpy()] = found["cnt"].to_numpy()

    def winners(self, bits: pa.Array) -> pa.Array:
        """Place of the class of each row; of equal scores the last one wins."""
        matrix, n = bit_matrix(bits, self.width, True), len(self.labels)
        own = [np.zeros(0, np.int64)]
        at_once = max(1, self.VOTES // self.first.size)
        for i in range(0, len(matrix), at_once):
            scores = bleached(self._votes(matrix[i : i + at_once]))
            own.append(n - 1 - np.argmax(scores[:, ::-1], axis=1))
        return pa.array(np.concatenate(own))

    def _votes(self, matrix: np.ndarray) -> np.ndarray:
        address = {
            c: np.stack([matrix[:, at] @ np.array(w, np.int64) for at, w in self.tuples[c]], axis=1) for c in set(self.clusters)
        }
        return np.stack([self.cells[first + address[c]] for first, c in zip(self.first, self.clusters, strict=True)], axis=2)


class GroupJudge:
    """Rows of groups beside the cells of their groups, many at a time (a task-side helper)."""

    def __init__(self, plan: list[list[dict]], of_votes: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.of_votes = of_votes
        self.tuples = [[(e["o"], [p["i"] for p in e["p"]], [p["w"] for p in e["p"]]) for e in own] for own in plan]
        self.width = max((i for own in self.tuples for _, at, _ in own for i in at), default=-1) + 1
        self.cells = max(e["o"] + 2 * max((p["w"] for p in e["p"]), default=1) for own in plan for e in own)

    def of(self, batch: pa.RecordBatch, known: pa.RecordBatch | None) -> tuple[pa.RecordBatch | None, pa.Array, np.ndarray]:
        """The last group's cells, for the next batch; the places of the rows whose group has cells; their values.

        ``known`` are the cells that the batch before ended with.
        """
        is_row = batch.column("_n").is_null().to_numpy(zero_copy_only=False)
        models = batch.filter(pa.array(~is_row))
        if known is not None:
            models = pa.concat_batches([known, models])
        own = np.flatnonzero(is_row)
        group = np.cumsum(~is_row)[own] - (known is None)
        if not models.num_rows:
            return None, pa.array(own[:0]), np.zeros(0)
        # A group without cells has none before its rows.
        own, group = own[group >= 0], group[group >= 0]
        same = pc.equal(batch.column("label").take(pa.array(own)), models.column("label").take(pa.array(group)))
        same = same.to_numpy(zero_copy_only=False)
        own, group = own[same], group[same]
        values = self._values(models, group, batch.column("_bits").take(pa.array(own)))
        return models.slice(models.num_rows - 1), pa.array(own), values

    def _values(self, models: pa.RecordBatch, group: np.ndarray, bits: pa.Array) -> np.ndarray:
        sizes = pc.list_value_length(models.column("k")).to_numpy()
        place, cnt, total = (models.column(c).flatten().to_numpy() for c in ("k", "cnt", "sum_y"))
        keys = np.repeat(np.arange(models.num_rows), sizes) * self.cells + place
        last = models.column("_n").to_numpy()[group]
        matrix = bit_matrix(bits, self.width)
        n, best = len(group), np.full(len(group), -1.0)
        votes, sums = np.zeros((n, len(self.tuples[0])), np.int64), np.zeros((n, len(self.tuples[0])))
        for c, own in enumerate(self.tuples):
            here = np.flatnonzero(last > c)
            if not len(here):
                break
            v, s = np.zeros((len(here), len(own)), np.int64), np.zeros((len(here), len(own)))
            for r, (first, at, weights) in enumerate(own):
                wanted = group[here] * self.cells + first + matrix[here][:, at] @ np.array(weights, np.int64)
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = keys[found] == wanted
                v[:, r], s[:, r] = np.where(hit, cnt[found], 0), np.where(hit, total[found], 0.0)
            top = v.max(axis=1)
            score = np.where(top > 0, v.sum(axis=1) / (np.maximum(top, 1) * len(own)), 0.0)
            better = score > best[here]
            best[here[better]], votes[here[better]], sums[here[better]] = score[better], v[better], s[better]
        return np.where(best > 0, self.of_votes(votes, sums), 0.0)


def _pattern(bits: str) -> Column:
    """Bits as a join key: a row without any is like one with none."""
    return F.coalesce(bits, F.array().cast("array<tinyint>")).alias("_bits")


def cluster_tuples(entry_size: int, tuple_size: int, limit: int, seed: int) -> dict[str, tuple]:
    """A mapping for every cluster number, shared by the groups."""
    mapping = random_mapping(entry_size, tuple_size, seed, [str(c) for c in range(limit)])
    return dict(mapping.tuples)


def _own_clusters(
    df: DataFrame, counts: DataFrame, keep: list[str], bits: str, size: int | None = None
) -> DataFrame:
    """Rows fanned out to the clusters of their own label; ``size`` is the measured bytes of ``counts``."""
    per = counts.groupBy("label").agg(F.max("cluster").alias("_last"))
    rows = lookup_join(df.select(*keep, "label", bits), per, ["label"], keep, size, how="inner")
    numbers = F.explode(F.sequence(F.lit(0), F.col("_last")))
    return rows.select(*keep, "label", bits, numbers.alias("cluster"))


def _addressed(rows: DataFrame, tuples: dict[str, tuple], bits: str, keep: list[str]) -> DataFrame:
    """``(keep..., ram_id, address)`` with the tuples of the row's cluster number."""
    plan = [
        [{f"p{j}": {"i": i, "w": 1 << j} for j, i in enumerate(tup)} | {"ram": r} for r, tup in enumerate(group)]
        for _, group in sorted(tuples.items(), key=lambda kv: int(kv[0]))
    ]
    width = max(len(t) for group in tuples.values() for t in group)
    body = ",".join(f"p{j}:struct<i:int,w:bigint>" for j in range(width))
    table = F.get(constant(plan, f"array<array<struct<ram:int,{body}>>>"), F.col("cluster"))
    out = rows.select(*keep, bits, F.explode(table).alias("_m"))
    address = sum(
        (
            F.coalesce(F.get(bits, F.col(f"_m.p{j}.i")).cast("bigint") * F.col(f"_m.p{j}.w"), F.lit(0))
            for j in range(width)
        ),
        F.lit(0).cast("bigint"),
    )
    return out.select(*keep, F.col("_m.ram").alias("ram_id"), address.alias("address"))


def _looked_up(
    rows: DataFrame, table: DataFrame, tuples: dict, bits: str, keep: list[str], size: int | None = None
) -> DataFrame:
    addressed = _addressed(rows, tuples, bits, keep)
    keys = ["label", "cluster", "ram_id", "address"]
    joined = lookup_join(addressed, table.select(*keys, "cnt", "sum_y"), keys, [keep[0], "ram_id"], size)
    return joined.select(
        *keep,
        "ram_id",
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.coalesce("sum_y", F.lit(0.0)).alias("sum_y"),
    )


def _similarity() -> Column:
    """Sum of votes over (largest vote x tuples), 0 when nothing was hit."""
    top = F.max("cnt")
    return F.when(top > 0, F.sum("cnt") / (top * F.count(F.lit(1)))).otherwise(F.lit(0.0))


def _scored(
    rows: DataFrame, table: DataFrame, tuples: dict, bits: str, keep: list[str], size: int | None = None
) -> DataFrame:
    looked = _looked_up(rows, table, tuples, bits, keep, size)
    return looked.groupBy(*keep).agg(_similarity().alias("score"))


def _counted(assigned: DataFrame, tuples: dict, bits: str) -> DataFrame:
    """Training: assigned patterns ``(label, cluster, bits, n, y)`` to address counts and target sums."""
    return (
        _addressed(assigned, tuples, bits, ["label", "cluster", "n", "y"])
        .groupBy("label", "cluster", "ram_id", "address")
        .agg(F.sum("n").alias("cnt"), F.sum("y").alias("sum_y"))
    )


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return (
        a.unionByName(b)
        .groupBy("label", "cluster", "ram_id", "address")
        .agg(F.sum("cnt").alias("cnt"), F.sum("sum_y").alias("sum_y"))
    )


COUNT_SCHEMA = "label string, cluster int, n bigint"
TABLE_SCHEMA = "label string, cluster int, ram_id int, address bigint, cnt bigint, sum_y double"


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, for which no task starts."""
    return spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])


def train_rounds(
    df: DataFrame,
    bits: str,
    entry_size: int,
    tuple_size: int,
    seed: int,
    order: str,
    group: str | None = None,
    y: str | None = None,
    rule: Rule = Rule(),
    first_slice: int = 64,
    start: ClusterModel | None = None,
) -> ClusterModel:
    """Clusters by rounds over doubling slices of the row order (``order`` is unique).

    Per round every row of the slice is scored against the frozen model.  Similar rows train
    their clusters; of the rest, the first row of each group with room opens a cluster and
    the others are scored again; groups without room train their most similar cluster.

    Bits and targets are computed once, order and group before that for the slices.  A score depends on group and bits only, so the equal rows of a slice are one
    pattern with a number; the first row of a pattern may open a cluster, which the others then fit.
    """
    spark = df.sparkSession
    key = F.col(group).cast("string") if group else F.lit("")
    target = F.col(y).cast("double") if y else F.lit(None).cast("double")
    rows = df.where(key.isNotNull()).select(
        F.col(order).cast("bigint").alias("_ord"), key.alias("label"), F.col(bits).alias("bits"), target.alias("y")
    )
    total = rows.count()
    ends = []
    size, reach = first_slice, 0
    while reach < total:
        reach = min(total, reach + size)
        ends.append(reach - 1)
        size *= 2
    # The last slice has no end but that of the rows.
    inner = ends[:-1]
    cuts = [int(s.value) for s in order_statistics(rows, [], "_ord", lambda _k, _n: inner)[()]] if inner else []
    tuples = cluster_tuples(entry_size, tuple_size, rule.limit, seed) | (start.tuples if start else {})
    table = start.table if start else _empty(spark, TABLE_SCHEMA)
    counts = start.counts if start else _empty(spark, COUNT_SCHEMA)
    patterns = cut_lineage(_patterns(rows, cuts), "_slice")
    known = counts.select("label").union(patterns.select("label")).distinct()
    most = DENSE_CELLS // sum(1 << len(t) for group_ in tuples.values() for t in group_)
    groups = sorted(r["label"] for r in known.limit(most + 1).collect())
    if len(groups) <= most:
        model = DenseClusters(groups, tuples, rule)
        model.add(table)
        begins = [-1, *ends[:-1]]
        for number, (begin, end) in enumerate(zip(begins, ends, strict=True)):
            own = patterns.where(F.col("_slice") == number).drop("_slice")
            # A slice is written by few tasks, and read by as few.
            tasks = min((end - begin) // SLICE_ROWS, 4 * spark.sparkContext.defaultParallelism)
            model.train(own.repartition(tasks) if tasks > 1 else own)
        return ClusterModel(*model.tables(spark), tuples, entry_size, rule)
    for number in range(len(ends)):
        pending = patterns.where(F.col("_slice") == number).drop("_slice")
        while True:
            step = cut_lineage(_round(pending, table, counts, tuples, rule))
            assigned = step.where(F.col("cluster").isNotNull())
            grown = assigned.groupBy("label", "cluster").agg(F.sum("n").alias("n"))
            counts = cut_lineage(
                counts.unionByName(grown).groupBy("label", "cluster").agg(F.sum("n").alias("n"))
            )
            table = cut_lineage(_merged(table, _counted(assigned, tuples, "bits")))
            pending = step.where(F.col("cluster").isNull()).drop("cluster")
            if pending.isEmpty():
                break
    return ClusterModel(table, counts, tuples, entry_size, rule)


def _patterns(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Equal rows of a slice: ``(_slice, label, bits, _ord, n, y, first_y)``, with the place and target of the
    first of them.

    Targets that are not finite are patterns of their own, so that a target can be taken off a sum.
    """
    number = sum(((F.col("_ord") > c).cast("int") for c in cuts), F.lit(0))
    odd = F.when(~_finite("y"), F.col("y"))
    return rows.groupBy(number.alias("_slice"), "label", "bits", odd.alias("_odd")).agg(
        F.min("_ord").alias("_ord"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("y"), F.lit(0.0)).alias("y"),
        F.coalesce(F.min_by("y", "_ord"), F.lit(0.0)).alias("first_y"),
    ).drop("_odd")


def _finite(name: str) -> Column:
    return F.coalesce(~F.isnan(name) & (F.abs(name) < float("inf")), F.lit(True))


def _opened(cluster: Column, opens: Column) -> Column:
    """``array<struct<cluster,n,y>>`` of a pattern without a cluster: its first row opens one, the others wait."""
    rest = F.when(_finite("first_y"), F.col("y") - F.col("first_y")).otherwise(F.col("y"))
    waiting = F.lit(None).cast("int")
    split = F.array(_part(cluster, F.lit(1).cast("bigint"), F.col("first_y")), _part(waiting, F.col("n") - 1, rest))
    return F.when(opens, F.filter(split, lambda p: p["n"] > 0)).otherwise(
        F.array(_part(waiting, F.col("n"), F.col("y")))
    )


def _part(cluster: Column, n: Column, y: Column) -> Column:
    return F.struct(cluster.cast("int").alias("cluster"), n.alias("n"), y.alias("y"))


def _divided(rows: DataFrame, count: Column, opens: Column, rule: Rule) -> DataFrame:
    """Patterns with ``fits`` and ``best`` by cluster; those to be scored again keep a null cluster."""
    whole = lambda c: _part(c, F.col("n"), F.col("y"))
    parts = (
        F.when(F.coalesce(F.size("fits"), F.lit(0)) > 0, F.transform("fits", whole))
        .when(count >= rule.limit, F.array(whole(F.col("best"))))
        .otherwise(_opened(count, opens))
    )
    return rows.select("_ord", "label", "bits", "first_y", F.explode(parts).alias("_p")).select(
        "_ord", "label", "bits", "first_y", "_p.cluster", "_p.n", "_p.y"
    )


class DenseClusters:
    """Clusters of few groups: all cells, whose number follows from groups, limit and tuples, are arrays.

    Patterns meet them by a broadcast; what comes back of a round are sums by cell.
    """

    def __init__(self, groups: list[str], tuples: dict[str, tuple], rule: Rule):
        self.groups, self.tuples, self.rule = groups, tuples, rule
        self.by_number = [group for _, group in sorted(tuples.items(), key=lambda kv: int(kv[0]))]
        self.first = [np.cumsum([0] + [1 << len(t) for t in group]) for group in self.by_number]
        shape = (len(groups), len(self.by_number), max((int(f[-1]) for f in self.first), default=0))
        self.counts, self.sums = np.zeros(shape, np.int64), np.zeros(shape)

    def sizes(self) -> list[list[int]]:
        """Rows of the clusters of each group: what its first tuple counted."""
        heads = [[int(self.counts[g, c, : f[1]].sum()) for c, f in enumerate(self.first)] for g in range(len(self.groups))]
        return [[n for n in own if n] for own in heads]

    def add(self, table: DataFrame) -> None:
        found = table.select(*[f.split()[0] for f in TABLE_SCHEMA.split(", ")]).toArrow()
        if not found.num_rows:
            return
        place = {lab: g for g, lab in enumerate(self.groups)}
        group = np.array([place[lab] for lab in found["label"].to_pylist()])
        cluster, ram, address, cnt, total = (found[i].to_numpy() for i in range(1, 6))
        width = max(len(f) for f in self.first)
        first = np.array([np.pad(f, (0, width - len(f))) for f in self.first])
        np.add.at(self.counts, (group, cluster, first[cluster, ram] + address), cnt)
        np.add.at(self.sums, (group, cluster, first[cluster, ram] + address), total)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Contents and counts, as :class:`ClusterModel` has them."""
        group, cluster, slot = np.nonzero(self.counts)
        ram = np.array([np.searchsorted(self.first[c], s, side="right") - 1 for c, s in zip(cluster, slot, strict=True)], np.int32)
        begin = np.array([self.first[c][r] for c, r in zip(cluster, ram, strict=True)], np.int64)
        names = pa.array([self.groups[g] for g in group], pa.string())
        columns = [names, cluster.astype(np.int32), ram, slot - begin, self.counts[group, cluster, slot], self.sums[group, cluster, slot]]
        table = pa.table(dict(zip([f.split()[0] for f in TABLE_SCHEMA.split(", ")], columns, strict=True)))
        sizes = [(lab, c, n) for lab, own in zip(self.groups, self.sizes(), strict=True) for c, n in enumerate(own)]
        made = spark.createDataFrame(table, TABLE_SCHEMA), spark.createDataFrame(sizes, COUNT_SCHEMA)
        return cut_lineage(made[0]), cut_lineage(made[1])

    def _judged(self, patterns: DataFrame) -> DataFrame:
        """Add ``fits`` and ``best`` (clusters of the pattern's group) and ``k``, their number."""
        names = patterns.columns
        judge = SliceJudge(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = judge.of(batch.column(names.index("label")), batch.column(names.index("bits")))
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*names, "k", "fits", "best"])

        none = F.lit(None)
        added = {"k": F.lit(0), "fits": none.cast("array<int>"), "best": none.cast("int")}
        return patterns.mapInArrow(run, patterns.withColumns(added).schema)

    def _learn(self, assigned: DataFrame) -> None:
        """Add patterns ``(label, cluster, bits, n, y)``: each task hands on the sums of its cells."""
        judge = SliceJudge(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(judge.counts.size, np.int64), np.zeros(judge.counts.size)
            for batch in batches:
                place = judge.places(batch.column(0), batch.column(1).to_numpy(), batch.column(2))
                np.add.at(counts, place, batch.column(3).to_numpy()[:, None])
                np.add.at(sums, place, batch.column(4).to_numpy()[:, None])
            # Every pattern counts, so a cell without a count has no sum.
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell]), pa.array(sums[cell])], names=["cell", "cnt", "sum_y"])

        parts = assigned.select("label", "cluster", "bits", "n", "y").mapInArrow(run, "cell bigint, cnt bigint, sum_y double")
        found = parts.groupBy("cell").agg(F.sum("cnt").alias("cnt"), F.sum("sum_y").alias("sum_y")).toArrow()
        cell = found["cell"].to_numpy()
        self.counts.reshape(-1)[cell] += found["cnt"].to_numpy()
        self.sums.reshape(-1)[cell] += found["sum_y"].to_numpy()

    def train(self, pending: DataFrame) -> None:
        """All rounds of a slice."""
        while True:
            judged = self._judged(pending)
            count, waiting = F.col("k"), []
            if any(len(own) < self.rule.limit for own in self.sizes()):
                judged = cut_lineage(judged)
                none_fits = judged.where((F.size("fits") == 0) & (count < self.rule.limit))
                waiting = none_fits.groupBy("label").agg(F.min("_ord").alias("o"), F.sum("n").alias("n")).collect()
            places = constant([{"l": r["label"], "o": r["o"]} for r in waiting], "array<struct<l:string,o:bigint>>")
            opens = F.array_contains(places, F.struct(F.col("label").alias("l"), F.col("_ord").alias("o")))
            step = _divided(judged, count, opens, self.rule)
            self._learn(step.where(F.col("cluster").isNotNull()))
            if all(r["n"] == 1 for r in waiting):
                return
            pending = step.where(F.col("cluster").isNull()).drop("cluster")


class SliceJudge:
    """Patterns against the frozen cells of their groups, as arrays (a task-side helper)."""

    def __init__(self, model: DenseClusters):
        self.rule, self.counts = model.rule, model.counts
        self.groups = pa.array(model.groups, pa.string())
        sizes = model.sizes()
        self.sizes = np.zeros(self.counts.shape[:2], np.int64)
        for g, own in enumerate(sizes):
            self.sizes[g, : len(own)] = own
        self.known = np.array([len(own) for own in sizes], np.int32)
        self.tuples = [
            [(int(o), list(tup), [1 << j for j in range(len(tup))]) for o, tup in zip(first[:-1], group, strict=True)]
            for first, group in zip(model.first, model.by_number, strict=True)
        ]
        self.width = max((i for own in self.tuples for _, at, _ in own for i in at), default=-1) + 1

    def _cells(self, matrix: np.ndarray, cluster: int) -> np.ndarray:
        """The cell of each tuple among those of a cluster."""
        return np.stack([o + matrix[:, at] @ np.array(w, np.int64) for o, at, w in self.tuples[cluster]], axis=1)

    def _group(self, labels: pa.Array) -> np.ndarray:
        return pc.index_in(labels, value_set=self.groups).to_numpy(zero_copy_only=False)

    def of(self, labels: pa.Array, bits: pa.Array) -> list[pa.Array]:
        """Known clusters of each pattern's group, those that it fits and the best of them, the last of equal ones."""
        group, matrix, limit = self._group(labels), bit_matrix(bits, self.width), self.counts.shape[1]
        score = np.full((len(group), limit), -1.0)
        for c in range(limit):
            some = np.flatnonzero(self.known[group] > c)
            votes = self.counts[group[some, None], c, self._cells(matrix[some], c)]
            top = votes.max(axis=1, initial=0)
            score[some, c] = np.where(top > 0, votes.sum(axis=1) / (np.maximum(top, 1) * votes.shape[1]), 0.0)
        needed = np.minimum(1.0, self.rule.min_score + self.sizes / self.rule.threshold)[group]
        fits = (score >= needed) & (score >= 0)
        row, cluster = np.nonzero(fits)
        ends = np.searchsorted(row, np.arange(len(group) + 1)).astype(np.int32)
        known = self.known[group]
        best = pa.array((limit - 1 - np.argmax(score[:, ::-1], axis=1)).astype(np.int32), mask=known == 0)
        return [pa.array(known), pa.ListArray.from_arrays(pa.array(ends), pa.array(cluster.astype(np.int32))), best]

    def places(self, labels: pa.Array, cluster: np.ndarray, bits: pa.Array) -> np.ndarray:
        """The cells of all groups and clusters that patterns train, ``(pattern, tuple)``."""
        group, matrix = self._group(labels), bit_matrix(bits, self.width)
        out = np.zeros((len(group), len(self.tuples[0])), np.int64)
        for c in range(self.counts.shape[1]):
            some = np.flatnonzero(cluster == c)
            out[some] = self._cells(matrix[some], c)
        return out + ((group * self.counts.shape[1] + cluster) * self.counts.shape[2])[:, None]


def _round(pending: DataFrame, table: DataFrame, known: DataFrame, tuples: dict, rule: Rule) -> DataFrame:
    """Assign pending patterns to clusters; patterns to be scored again keep a null cluster.

    The model and the cluster counts are checkpointed, so measuring them is cheap; they are
    broadcast only when they turn out small.
    """
    small, large = known.count() * ROW_BYTES, table.count() * ROW_BYTES
    room = known.groupBy("label").agg(F.count(F.lit(1)).cast("int").alias("k"))
    fanned = _own_clusters(pending, known, ["_ord"], "bits", small)
    scores = _scored(fanned, table, tuples, "bits", ["_ord", "label", "cluster"], large)
    judged = lookup_join(scores, known, ["label", "cluster"], ["_ord"], small, how="inner").select(
        "_ord", "cluster", "score", (F.col("score") >= rule.needed(F.col("n"))).alias("fits")
    )
    per_row = judged.groupBy("_ord").agg(
        F.collect_list(F.when(F.col("fits"), F.col("cluster"))).alias("fits"),
        F.max_by("cluster", F.struct("score", "cluster")).alias("best"),
    )
    rows = lookup_join(pending.join(per_row, "_ord", "left"), room, ["label"], ["_ord"], small)
    count = F.coalesce("k", F.lit(0))
    none_fits = F.coalesce(F.size("fits"), F.lit(0)) <= 0
    first = (
        rows.where(none_fits & (count < rule.limit))
        .groupBy("label")
        .agg(F.min("_ord").alias("_first"))
    )
    placed = lookup_join(rows, first, ["label"], ["_ord"], measure=False)
    opens = F.coalesce(F.col("_ord") == F.col("_first"), F.lit(False))
    return _divided(placed, count, opens, rule)


# -- row by row --------------------------------------------------------------


class Leaders:
    """Clusters of one group as address counters: the row-by-row rule (a task-side helper)."""

    def __init__(self, rule: Rule, n_rams: int):
        self.rule, self.n_rams = rule, n_rams
        self.counts: list[dict] = []
        self.sums: list[dict] = []
        self.sizes: list[int] = []

    def train(self, addresses: np.ndarray, y: float = 0.0) -> list[int]:
        """``addresses[cluster number][tuple]`` of one row; returns the clusters it trained."""
        return self.train_cells([[(r, int(a)) for r, a in enumerate(own)] for own in addresses], y)

    def train_cells(self, cells: list[list[tuple[int, int]]], y: float = 0.0) -> list[int]:
        """The same for ``(tuple, address)`` by cluster number."""
        rule, sizes = self.rule, self.sizes
        fits, best, most = [], -1, -1.0
        for c, own in enumerate(self.counts):
            votes = [own.get(k, 0) for k in cells[c]]
            top = max(votes)
            score = sum(votes) / (top * self.n_rams) if top > 0 else 0.0
            if score >= min(1.0, rule.min_score + sizes[c] / rule.threshold):
                fits.append(c)
            if score >= most:
                best, most = c, score
        if not fits and len(sizes) < rule.limit:
            fits = [len(sizes)]
            self.counts.append({})
            self.sums.append({})
            sizes.append(0)
        if not fits:
            fits = [best]
        for c in fits:
            counts, sums = self.counts[c], self.sums[c]
            for k in cells[c]:
                counts[k] = counts.get(k, 0) + 1
                sums[k] = sums.get(k, 0.0) + y
            sizes[c] += 1
        return fits


def all_addresses(tuples: dict[str, tuple], bits: str) -> Column:
    """Addresses of a row under every cluster number: ``array<array<bigint>>``."""
    groups = sorted(tuples, key=int)
    mapping = Mapping(0, dict(tuples))
    return F.array(*[tuple_addresses(mapping, BitColumn(bits), g) for g in groups])


class PatternCells:
    """Cells ``(tuple, address)`` of a row under every cluster number, computed once for each pattern of bits."""

    def __init__(self, tuples: dict[str, tuple]):
        self.groups = [tuples[c] for c in sorted(tuples, key=int)]
        self.known: dict[bytes, list] = {}

    def of(self, pattern: bytes) -> list[list[tuple[int, int]]]:
        found = self.known.get(pattern)
        if found is None:
            if len(self.known) >= PATTERNS:
                self.known.clear()
            bits = np.frombuffer(pattern, np.int32).tolist()
            if max((i for group in self.groups for tup in group for i in tup), default=-1) >= len(bits):
                raise ValueError("a row has fewer bits than the mapping refers to")
            found = [[(r, sum(bits[i] << j for j, i in enumerate(tup))) for r, tup in enumerate(group)] for group in self.groups]
            self.known[pattern] = found
        return found


class StepLeaders:
    """The row-by-row rule for many groups of few cells in step: the first rows of all groups, then the second ones
    and so on, so that a step is some array operations (a task-side helper)."""

    def __init__(self, rule: Rule, tuples: dict[str, tuple]):
        self.rule = rule
        groups = [tuples[c] for c in sorted(tuples, key=int)]
        sizes = [1 << len(t) for own in groups for t in own]
        first = np.cumsum([0, *sizes])
        self.cells, self.n_rams = int(first[-1]), len(groups[0])
        place = [(o, list(t), [1 << j for j in range(len(t))]) for o, t in zip(first.tolist(), (t for own in groups for t in own))]
        self.place = place
        self.cluster = np.repeat(np.arange(len(sizes)) // self.n_rams, sizes).astype(np.int32)
        self.ram = np.repeat(np.arange(len(sizes)) % self.n_rams, sizes).astype(np.int32)
        self.address = np.arange(self.cells) - np.repeat(first[:-1], sizes)

    def of(self, labels: pa.Array, begin: np.ndarray, length: np.ndarray, bits: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Clusters of the groups whose rows begin in ``bits`` (row, bit) and ``y`` at ``begin``."""
        at_once = max(1, CELLS_IN_STEP // self.cells)
        by_length = np.argsort(-length, kind="stable")
        for i in range(0, len(length), at_once):
            own = by_length[i : i + at_once]
            yield self._trained(labels.take(pa.array(own)), begin[own], length[own], bits, y)

    def _trained(self, labels: pa.Array, begin: np.ndarray, length: np.ndarray, bits: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        rule, n, limit = self.rule, len(begin), self.rule.limit
        counts, sums = np.zeros(n * self.cells, np.int64), np.zeros(n * self.cells)
        sizes, known, numbers = np.zeros((n, limit), np.int64), np.zeros(n, np.int64), np.arange(limit)
        # Groups stand by falling length, so those with a row left come first.
        left = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for step, some in enumerate(left.tolist()):
            rows = begin[:some] + step
            own = bits[rows]
            cell = np.stack([first + own[:, at] @ np.array(w, np.int64) for first, at, w in self.place], axis=1)
            cell = (cell + np.arange(some)[:, None] * self.cells).reshape(some, limit, self.n_rams)
            votes = counts[cell]
            top = votes.max(axis=2)
            score = np.where(top > 0, votes.sum(axis=2) / (np.maximum(top, 1) * self.n_rams), 0.0)
            needed = np.minimum(1.0, rule.min_score + sizes[:some] / rule.threshold)
            fits = (score >= needed) & (numbers < known[:some, None])
            alone = np.flatnonzero(~fits.any(axis=1))
            room = known[alone] < limit
            opened, full = alone[room], alone[~room]
            fits[opened, known[opened]] = True
            known[opened] += 1
            # Of equal scores the last cluster is trained.
            fits[full, limit - 1 - np.argmax(score[full][:, ::-1], axis=1)] = True
            group, cluster = np.nonzero(fits)
            hit = cell[group, cluster]
            counts[hit] += 1
            sums[hit] += y[rows][group][:, None]
            sizes[group, cluster] += 1
        found = np.flatnonzero(counts)
        group, slot = found // self.cells, found % self.cells
        heads = group * limit + self.cluster[slot]
        starts = np.flatnonzero(np.diff(heads, prepend=-1))
        own, cluster = heads[starts] // limit, heads[starts] % limit
        ends = pa.array(np.append(starts, len(heads)).astype(np.int32))
        cells = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (self.ram[slot], self.address[slot], counts[found], sums[found])]
        columns = [labels.take(pa.array(own)), pa.array(cluster.astype(np.int32)), pa.array(sizes[own, cluster]), *cells]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CLUSTER_SCHEMA.split(", ")])


CLUSTER_SCHEMA = "label string, cluster int, size bigint, ram_id array<int>, address array<bigint>, cnt array<bigint>, sum_y array<double>"


def _whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Labels, first ``width`` bits and targets of the rows of whole groups, many groups at a time."""
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
    n = 0

    def joined() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        labels, bits, targets = zip(*held, strict=True)
        return pa.concat_arrays(labels), np.concatenate(bits), np.concatenate(targets)

    for batch in batches:
        if not batch.num_rows:
            continue
        bits = batch.column(1)
        sizes = pc.list_value_length(bits).to_numpy(zero_copy_only=False)
        if bits.null_count or bits.flatten().null_count or (sizes < width).any():
            raise ValueError("a row has fewer bits than the mapping refers to")
        values = bits.flatten().to_numpy()
        first = np.cumsum(sizes) - sizes
        held.append((batch.column(0), values[first[:, None] + np.arange(width)], batch.column(2).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        last = batch.column(0)[batch.num_rows - 1]
        if n < ROWS_AT_ONCE or held[0][0][0] == last:
            continue
        labels, bits, targets = joined()
        end = int(np.flatnonzero(pc.not_equal(labels, last).to_numpy(zero_copy_only=False))[-1]) + 1
        yield labels[:end], bits[:end], targets[:end]
        held, n = [(labels[end:], bits[end:], targets[end:])], len(labels) - end
    if n:
        yield joined()


class ClusterRows:
    """A row for each cluster of the groups that are done, as Arrow batches of :data:`CLUSTER_SCHEMA`."""

    def __init__(self) -> None:
        self.heads: list[tuple] = []
        self.ends, self.cells, self.sums = [0], [], []

    def add(self, label: str, leaders: Leaders) -> None:
        for c, own in enumerate(leaders.counts):
            self.heads.append((label, c, leaders.sizes[c]))
            self.cells.extend([(r, a, n) for (r, a), n in own.items()])
            self.sums.extend([leaders.sums[c][k] for k in own])
            self.ends.append(len(self.cells))

    def batch(self) -> pa.RecordBatch:
        heads = list(zip(*self.heads, strict=True)) or [(), (), ()]
        cells = list(zip(*self.cells, strict=True)) or [(), (), ()]
        types = (pa.string(), pa.int32(), pa.int64()), (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        ends = pa.array(self.ends, pa.int32())
        columns = [pa.array(h, t) for h, t in zip(heads, types[0], strict=True)]
        columns += [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in zip([*cells, self.sums], types[1], strict=True)]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CLUSTER_SCHEMA.split(", ")])


def train_sequential(
    df: DataFrame,
    bits: str,
    entry_size: int,
    tuple_size: int,
    seed: int,
    order: str,
    group: str,
    y: str | None = None,
    rule: Rule = Rule(),
) -> ClusterModel:
    """Row-by-row clusters; parallelism is the number of groups, group sizes are checked.

    Groups stream through the tasks in order; a group needs no call of its own.  Groups of few cells are
    trained in step, the others one after another, where a pattern of bits is taken apart once.  Use :func:`train_rounds` for groups beyond
    ``GROUP_ROWS``.
    """
    tuples = cluster_tuples(entry_size, tuple_size, rule.limit, seed)
    n_rams = len(tuples["0"])
    key = F.col(group).cast("string")
    rows = df.where(key.isNotNull()).select(
        key.alias("label"),
        F.col(order).alias("_ord"),
        F.col(bits).cast("array<tinyint>").alias("bits"),
        (F.col(y).cast("double") if y else F.lit(0.0)).alias("y"),
    )
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    if largest > GROUP_ROWS:
        raise ValueError(f"a group has {largest} rows; use train_rounds")

    width = max((i for group_ in tuples.values() for t in group_ for i in t), default=-1) + 1
    in_step = sum(1 << len(t) for group_ in tuples.values() for t in group_) <= GROUP_CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, done, steps = PatternCells(tuples), ClusterRows(), StepLeaders(rule, tuples) if in_step else None
        for labels, matrix, targets in _whole_groups(batches, width):
            codes = labels.dictionary_encode().indices.to_numpy()
            begin = np.flatnonzero(np.diff(codes, prepend=-1))
            length = np.diff(np.append(begin, len(codes)))
            # Groups that outlast all but a few others go row by row.
            usual = np.partition(length, -LANES - 1)[-LANES - 1] if len(length) > LANES else 0
            together = (length <= 4 * usual) & in_step
            names = labels.take(pa.array(begin))
            if together.any():
                own = np.flatnonzero(together)
                yield from steps.of(names.take(pa.array(own)), begin[own], length[own], matrix, targets)
            for g in np.flatnonzero(~together).tolist():
                leaders = Leaders(rule, n_rams)
                for i in range(begin[g], begin[g] + length[g]):
                    leaders.train_cells(cells.of(matrix[i].astype(np.int32).tobytes()), float(targets[i]))
                done.add(names[g].as_py(), leaders)
                if len(done.cells) >= CELLS_AT_ONCE:
                    yield done.batch()
        yield done.batch()

    # A given number of partitions is not merged by size: rows are few bytes and much work.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "label").sortWithinPartitions("label", "_ord").select("label", "bits", "y")
    made = cut_lineage(ordered.mapInArrow(run, CLUSTER_SCHEMA))
    cells = F.explode(F.arrays_zip("ram_id", "address", "cnt", "sum_y")).alias("_c")
    table = made.select("label", "cluster", cells).select("label", "cluster", "_c.*")
    counts = made.select("label", "cluster", F.col("size").alias("n"))
    return ClusterModel(table, counts, tuples, entry_size, rule)


def train_semi_supervised(
    df: DataFrame, bits: str, entry_size: int, tuple_size: int, seed: int, order: str,
    label: str = "label", rule: Rule = Rule(), first_slice: int = 64,
) -> ClusterModel:
    """Labelled rows first; unlabelled rows then train under the label that model gives them."""
    model = train_rounds(
        df.where(F.col(label).isNotNull()), bits, entry_size, tuple_size, seed, order, label, rule=rule,
        first_slice=first_slice,
    )
    rest = df.where(F.col(label).isNull()).select(order, bits)
    guessed = cut_lineage(model.classify(rest, bits).select(order, bits, F.col("predicted").alias(label)))
    return train_rounds(
        guessed, bits, entry_size, tuple_size, seed, order, label, rule=rule,
        first_slice=first_slice, start=model,
    )


def single_regression(model: ClusterModel, label: str, cluster: int, mean) -> RegressionModel:
    """One cluster as a regression model of its own."""
    table = model.table.where((F.col("label") == label) & (F.col("cluster") == cluster)).drop("label", "cluster")
    return RegressionModel(table, Mapping(model.entry_size, {"": model.tuples[str(cluster)]}), mean)


def cluster_counts(model: ClusterModel) -> DataFrame:
    """Clusters and trained rows per label."""
    per_label = F.count(F.lit(1)).over(W.partitionBy("label"))
    return model.counts.withColumn("clusters", per_label)
