"""Scoring imported lookup-table networks and continuous-Bloom ensembles over whole tables.

Parameters arrive as model tables.  Those of small networks become constants of the plan, and
scoring is a projection without a shuffle; :class:`LutTables` scores larger ones by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bit, constant, let
from ..functions.joins import lookup_join
from ..session import cut_lineage
from .address import Mapping
from .decide import first_winner
from .order import ranked

PARAMETER_LIMIT = 1 << 20


def _bounded(table: DataFrame, columns: list[str]) -> list:
    rows = table.select(*columns).limit(PARAMETER_LIMIT + 1).collect()
    if len(rows) > PARAMETER_LIMIT:
        raise ValueError("the network is too large to be a constant of the plan; use LutTables or BloomTables")
    return rows


@dataclass(frozen=True)
class LutNetwork:
    """Layers of lookup tables; ``values`` is ``(layer, lut, addr, value)``."""

    mappings: tuple[Mapping, ...]
    tables: tuple[tuple[tuple[float, ...], ...], ...]
    labels: list[str]
    tau: float = 1.0

    @staticmethod
    def of(values: DataFrame, mappings: list[Mapping], labels: list[str], tau: float = 1.0) -> LutNetwork:
        layers: dict[int, dict[int, dict[int, float]]] = {}
        for r in _bounded(values, ["layer", "lut", "addr", "value"]):
            layers.setdefault(r[0], {}).setdefault(r[1], {})[r[2]] = r[3]
        tables = []
        for layer, mapping in enumerate(mappings):
            tables.append(
                tuple(
                    tuple(layers[layer][lut].get(a, 0.0) for a in range(2 ** len(tup)))
                    for lut, tup in enumerate(mapping.of(""))
                )
            )
        return LutNetwork(tuple(mappings), tuple(tables), labels, tau)

    def outputs(self, bits: Column) -> Column:
        """Bits of the last layer: each table answers value > 0 at its address."""
        out = bits
        for mapping, tables in zip(self.mappings, self.tables, strict=True):
            plan = constant(
                [
                    {"i": list(reversed(tup)), "v": [int(v > 0) for v in table]}
                    for tup, table in zip(mapping.of(""), tables, strict=True)
                ],
                "array<struct<i:array<int>,v:array<int>>>",
            )
            out = _layer(out, plan)
        return out

    def scores(self, bits: Column) -> Column:
        return group_sum(self.outputs(bits), len(self.tables[-1]), len(self.labels), self.tau)

    def predict(self, df: DataFrame, bits: str) -> DataFrame:
        return df.withColumn("predicted", first_winner(self.scores(F.col(bits)), self.labels))


@dataclass(frozen=True)
class LutTables:
    """The network of any size: its parameters stay in the table ``(layer, lut, addr, value)``.

    Rows with equal bits are scored once.  Each layer joins the addresses of its tables with the
    parameters, split by salt, and regroups the answers.
    """

    values: DataFrame
    mappings: tuple[Mapping, ...]
    labels: list[str]
    tau: float = 1.0

    def predict(self, df: DataFrame, bits: str) -> DataFrame:
        """Add ``scores`` and ``predicted``; every row comes out once with all its columns."""
        place = ["_p1", "_p2"]
        marked = df.withColumns({"_p1": F.xxhash64(bits), "_p2": F.hash(bits)})
        state = marked.select(*place, F.col(bits).alias("_b")).dropDuplicates(place)
        for layer, mapping in enumerate(self.mappings):
            plan = constant([list(reversed(tup)) for tup in mapping.of("")], "array<array<int>>")
            addresses = let(F.col("_b"), _lut_addresses(plan))
            asked = state.select(*place, F.posexplode(addresses).alias("lut", "addr"))
            own = self.values.where(F.col("layer") == layer).select(
                F.col("lut").cast("int").alias("lut"), F.col("addr").cast("int").alias("addr"), bit(F.col("value") > 0).alias("v")
            )
            answers = lookup_join(asked, own, ["lut", "addr"], ["_p1", "lut"]).groupBy(*place)
            ordered = F.array_sort(F.collect_list(F.struct("lut", F.coalesce("v", F.lit(0)).alias("v"))))
            state = answers.agg(F.transform(ordered, lambda e: e["v"]).alias("_b"))
        scores = group_sum(F.col("_b"), self.mappings[-1].n_rams, len(self.labels), self.tau)
        scored = state.select(*place, scores.alias("scores"))
        joined = lookup_join(marked, scored, place, how="inner").drop(*place)
        return joined.withColumn("predicted", first_winner(F.col("scores"), self.labels))


def _lut_addresses(plan: Column):
    return lambda bits: F.transform(plan, lambda tup: _lut_address(bits, tup))


def _lut_address(bits: Column, tup: Column) -> Column:
    return F.aggregate(tup, F.lit(0), lambda acc, i: acc * 2 + F.coalesce(F.get(bits, i).cast("int"), F.lit(0)))


def _layer(bits: Column, plan: Column) -> Column:
    return let(
        bits,
        lambda b: F.transform(
            plan,
            lambda lut: F.get(lut["v"], _lut_address(b, lut["i"])),
        ),
    )


def group_sum(
    values: Column, n_values: int, k: int, tau: float, order: list[int] | None = None
) -> Column:
    """Sums of ``k`` equal slices over ``tau``; a short first slice is padded on the left."""
    if order is not None:
        places = constant(order, "array<int>")
        values = let(values, lambda v: F.transform(places, lambda i: F.get(v, i)))
    pad = -n_values % k
    size = (n_values + pad) // k
    return let(
        F.concat(F.array_repeat(F.lit(0.0), pad), values.cast("array<double>")),
        lambda v: F.array(
            *[
                F.aggregate(F.slice(v, g * size + 1, size), F.lit(0.0), lambda s, x: s + x) / F.lit(tau)
                for g in range(k)
            ]
        ),
    )


def lut_spectrum(values: DataFrame, tuple_size: int) -> DataFrame:
    """Squared norm of the Fourier coefficients of every table: ``(layer, lut, energy)``.

    coefficient j = sum over i of value_i * (-1)^popcount(i & ~j) / 2^n.
    """
    size = 1 << tuple_size
    columns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint")))
    sign = F.lit(1.0) - 2.0 * (F.bit_count(F.col("addr").cast("bigint").bitwiseAND(F.bitwise_not("j"))) % 2)
    return (
        values.select("layer", "lut", "addr", "value", columns.alias("j"))
        .groupBy("layer", "lut", "j")
        .agg((F.sum(F.col("value") * sign) / size).alias("c"))
        .groupBy("layer", "lut")
        .agg(F.sum(F.col("c") * F.col("c")).alias("energy"))
    )


@dataclass(frozen=True)
class BloomTables:
    """A submodel of any size: its slots, mask and bias stay in tables.

    ``values``: ``(label, filter, slot, value)``; a slot that is missing counts as not negative.
    ``mask``: ``(label, filter, weight)``, 1 where missing.  ``bias``: ``(label, bias)``, 0 where missing.

    A filter answers with the smallest sign over its hashed slots, so it answers -1 if one of them is
    negative and 1 otherwise.  Only the negative slots are therefore joined: once for each different
    row of bits, then grouped by filter and label, then summed over the filters.
    """

    values: DataFrame
    mapping: Mapping
    constants: list[list[int]]
    n_slots: int
    labels: list[str]
    mask: DataFrame | None = None
    bias: DataFrame | None = None

    def _slots(self, bits: Column) -> Column:
        """For each filter the different slots of its tuple."""
        plan = constant([list(tup) for tup in self.mapping.of("")], "array<array<int>>")
        hashes = constant(self.constants, "array<array<bigint>>")

        def slot(b: Column, tup: Column, consts: Column) -> Column:
            hashed = F.zip_with(tup, consts, lambda i, h: F.coalesce(F.get(b, i).cast("bigint"), F.lit(0)) * h)
            return (F.aggregate(hashed, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(h)) % F.lit(self.n_slots)).cast("int")

        def of_filter(b: Column, tup: Column) -> Column:
            return F.array_distinct(F.transform(hashes, lambda consts: slot(b, tup, consts)))

        return let(bits, lambda b: F.transform(plan, lambda tup: of_filter(b, tup)))

    def silent(self, patterns: DataFrame, place: list[str], bits: str) -> DataFrame:
        """``(place..., label, filter)`` of the answers -1; ``patterns`` is unique on ``place``."""
        asked = patterns.select(*place, F.posexplode(self._slots(F.col(bits))).alias("filter", "_s"))
        asked = asked.select(*place, "filter", F.explode("_s").alias("slot"))
        known = F.col("label").isin(self.labels)
        negative = self.values.where(known & (F.col("value") < 0)).groupBy("filter", "slot").agg(F.collect_set("label").alias("_labels"))
        negative = negative.select(F.col("filter").cast("int").alias("filter"), F.col("slot").cast("int").alias("slot"), "_labels")
        met = lookup_join(asked, negative, ["filter", "slot"], place, how="inner")
        return met.select(*place, "filter", F.explode("_labels").alias("label")).distinct()

    def _weights(self) -> DataFrame:
        """``(label, filter, weight)`` for every label and filter."""
        spark = self.values.sparkSession
        cells = spark.range(self.mapping.n_rams).select(
            F.col("id").cast("int").alias("filter"), F.explode(constant(self.labels, "array<string>")).alias("label")
        )
        if self.mask is None:
            return cells.withColumn("weight", F.lit(1).cast("bigint"))
        given = self.mask.select("label", F.col("filter").cast("int").alias("filter"), F.col("weight").cast("bigint").alias("weight"))
        return cells.join(given, ["label", "filter"], "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("bigint")))

    def logits(self, patterns: DataFrame, place: list[str], bits: str) -> DataFrame:
        """``(place..., logits)``, an array in label order, for each pattern."""
        weights = self._weights()
        bias = {} if self.bias is None else {r["label"]: r["bias"] for r in self.bias.where(F.col("label").isin(self.labels)).collect()}
        full = {r["label"]: r["w"] for r in weights.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        lost = self.silent(patterns, place, bits)
        if self.mask is not None:
            lost = lookup_join(lost, weights, ["label", "filter"], place, how="inner")
        else:
            lost = lost.withColumn("weight", F.lit(1).cast("bigint"))
        sums = [F.coalesce(F.sum(F.when(F.col("label") == lab, F.col("weight"))), F.lit(0)).alias(f"_l{i}") for i, lab in enumerate(self.labels)]
        per_pattern = patterns.select(*place).join(lost.groupBy(*place).agg(*sums), place, "left")
        out = [
            (F.lit(full[lab]) - 2 * F.coalesce(F.col(f"_l{i}"), F.lit(0))).cast("double") + F.lit(float(bias.get(lab, 0.0)))
            for i, lab in enumerate(self.labels)
        ]
        return per_pattern.select(*place, F.array(*out).alias("logits"))

    def filter_scores(self, df: DataFrame, bits: str, label: str) -> DataFrame:
        """As :func:`filter_scores`, from the counts of rows and of silent rows by label."""
        n = len(self.labels)
        place = ["_p1", "_p2"]
        marked = df.select(F.col(label).cast("string").alias("_own"), F.col(bits).alias("_b"))
        marked = marked.withColumns({"_p1": F.xxhash64("_b"), "_p2": F.hash("_b")})
        counts = marked.groupBy(*place, "_own").agg(F.count(F.lit(1)).alias("_n"))
        patterns = marked.select(*place, "_b").dropDuplicates(place)
        silent = self.silent(patterns, place, "_b").join(counts, place)
        weight = F.when(F.col("_own") == F.col("label"), -F.lit(n - 1)).otherwise(F.lit(1)) * F.col("_n")
        below = silent.groupBy("label", "filter").agg(F.sum(weight).alias("_below"))
        # Every row answers 1 unless it is silent: the sum is that of all rows less twice the silent ones.
        totals = {r["_own"]: r["n"] for r in marked.where(F.col("_own").isin(self.labels)).groupBy("_own").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = marked.count()
        whole = self.values.sparkSession.createDataFrame(
            [(lab, rows - n * totals.get(lab, 0)) for lab in self.labels], "label string, _all bigint"
        )
        cells = self._weights().select("label", "filter").join(F.broadcast(whole), "label").join(below, ["label", "filter"], "left")
        per_label = cells.withColumn("score", 2 * F.coalesce("_below", F.lit(0)) - F.col("_all"))
        return per_label.groupBy("filter").agg(F.max("score").alias("score"))


def ensemble_tables_predict(layers: list[BloomTables], df: DataFrame, bits: str) -> DataFrame:
    """Add ``predicted``; every row comes out once with all its columns.  Equal bits are scored once."""
    place = ["_p1", "_p2"]
    marked = df.withColumns({"_p1": F.xxhash64(bits), "_p2": F.hash(bits)})
    patterns = cut_lineage(marked.select(*place, F.col(bits).alias("_b")).dropDuplicates(place))
    total = None
    for layer in layers:
        own = layer.logits(patterns, place, "_b")
        if total is None:
            total = own
            continue
        both = total.join(own.withColumnRenamed("logits", "_more"), place)
        total = both.select(*place, F.zip_with("logits", "_more", lambda a, b: a + b).alias("logits"))
    won = total.select(*place, first_winner(F.col("logits"), layers[0].labels).alias("predicted"))
    return lookup_join(marked, won, place, how="inner").drop(*place)


@dataclass(frozen=True)
class BloomLayer:
    """One submodel: ``table`` is ``(label, filter, slot, value)``, plus hash constants."""

    mapping: Mapping
    constants: list[list[int]]
    n_slots: int
    labels: list[str]
    signs: tuple[tuple[tuple[int, ...], ...], ...]
    """filter -> slot -> sign per label."""
    mask: tuple[tuple[int, ...], ...] | None = None
    bias: tuple[float, ...] | None = None

    @staticmethod
    def of(
        table: DataFrame,
        mapping: Mapping,
        constants: list[list[int]],
        n_slots: int,
        labels: list[str],
        mask: list[list[int]] | None = None,
        bias: list[float] | None = None,
    ) -> BloomLayer:
        place = {lab: c for c, lab in enumerate(labels)}
        signs = [[[1] * len(labels) for _ in range(n_slots)] for _ in range(mapping.n_rams)]
        for r in _bounded(table, ["label", "filter", "slot", "value"]):
            signs[r[1]][r[2]][place[r[0]]] = 1 if r[3] >= 0 else -1
        return BloomLayer(
            mapping,
            constants,
            n_slots,
            labels,
            tuple(tuple(tuple(s) for s in f) for f in signs),
            None if mask is None else tuple(tuple(m) for m in mask),
            None if bias is None else tuple(bias),
        )

    def responses(self, bits: Column) -> Column:
        """Per filter and label: the smallest sign over the hashed slots."""
        n_labels = len(self.labels)
        plan = constant(
            [
                {"i": list(tup), "s": [list(v) for v in signs]}
                for tup, signs in zip(self.mapping.of(""), self.signs, strict=True)
            ],
            "array<struct<i:array<int>,s:array<array<int>>>>",
        )
        hashes = constant(self.constants, "array<array<bigint>>")

        def one(b: Column, flt: Column) -> Column:
            slots = F.transform(
                hashes,
                lambda consts: (
                    F.aggregate(
                        F.zip_with(
                            flt["i"],
                            consts,
                            lambda i, h: F.coalesce(F.get(b, i).cast("bigint"), F.lit(0)) * h,
                        ),
                        F.lit(0).cast("bigint"),
                        lambda acc, h: acc.bitwiseXOR(h),
                    )
                    % F.lit(self.n_slots)
                ).cast("int"),
            )
            return let(
                slots,
                lambda q: F.array(
                    *[_smallest_sign(q, flt, c) for c in range(n_labels)]
                ),
            )

        return let(bits, lambda b: F.transform(plan, lambda flt: one(b, flt)))

    def logits(self, bits: Column) -> Column:
        """Sum over filters (masked after pruning) plus bias, per label."""
        n_labels = len(self.labels)
        responses = self.responses(bits)
        if self.mask is not None:
            weights = constant([list(r) for r in zip(*self.mask, strict=True)], "array<array<int>>")
            responses = F.zip_with(
                responses, weights, lambda r, w: F.zip_with(r, w, lambda a, m: a * m)
            )
        bias = self.bias or (0.0,) * n_labels
        return let(
            responses,
            lambda rs: F.array(*[_column_sum(rs, c) + F.lit(float(bias[c])) for c in range(n_labels)]),
        )

    def pruned(self, keep: list[int]) -> BloomLayer:
        """Only the given filters."""
        tuples = self.mapping.of("")
        return BloomLayer(
            Mapping(self.mapping.entry_size, {"": tuple(tuples[f] for f in keep)}),
            self.constants,
            self.n_slots,
            self.labels,
            tuple(self.signs[f] for f in keep),
            None,
            self.bias,
        )

    def size_bytes(self, metadata: bool = False) -> int:
        """One bit per slot; hash constants (8 bytes) and input order (4 bytes) on request."""
        rams = self.mapping.n_rams
        size = -(-len(self.labels) * rams * self.n_slots // 8)
        if metadata:
            size += 8 * sum(len(c) for c in self.constants) + 4 * self.mapping.entry_size
        return size


def _smallest_sign(slots: Column, flt: Column, c: int) -> Column:
    return F.array_min(F.transform(slots, lambda s: F.get(F.get(flt["s"], s), F.lit(c))))


def _column_sum(rows: Column, c: int) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.get(r, F.lit(c)))


def ensemble_logits(layers: list[BloomLayer], bits: str) -> Column:
    """Sum of the submodels' logits."""
    total = layers[0].logits(F.col(bits))
    for layer in layers[1:]:
        total = F.zip_with(total, layer.logits(F.col(bits)), lambda a, b: a + b)
    return total


def ensemble_predict(layers: list[BloomLayer], df: DataFrame, bits: str) -> DataFrame:
    return df.withColumn("predicted", first_winner(ensemble_logits(layers, bits), layers[0].labels))


def filter_scores(layer: BloomLayer, df: DataFrame, bits: str, label: str) -> DataFrame:
    """Pruning score of each filter: responses against it, its own class weighted C - 1.

    score(label, filter) = -sum of responses, where rows of that label count -(C - 1) times;
    a filter's score is its best over the labels.
    """
    n_labels = len(layer.labels)
    names = constant(layer.labels, "array<string>")
    cells = df.select(
        F.col(label).cast("string").alias("sample"),
        F.posexplode(layer.responses(F.col(bits))).alias("filter", "row"),
    ).select("sample", "filter", F.posexplode("row").alias("c", "response"))
    own = F.col("sample") == F.get(names, F.col("c"))
    signed = F.when(own, -F.lit(n_labels - 1) * F.col("response")).otherwise(F.col("response"))
    per_label = cells.groupBy("c", "filter").agg((-F.sum(signed)).alias("score"))
    return per_label.groupBy("filter").agg(F.max("score").alias("score"))


def filters_to_keep(scores: DataFrame, n_filters: int, ratio: float) -> DataFrame:
    """Drop the ``int(ratio * n_filters)`` filters with the lowest score."""
    drop = int(ratio * n_filters)
    if drop <= 0 or drop >= n_filters:
        return scores
    return ranked(scores, [], "score", "filter", "_r").where(F.col("_r") >= drop).drop("_r")


def lut_bytes(network: LutNetwork) -> int:
    """One bit per table entry and four bytes per mapped input."""
    entries = sum(len(t) for layer in network.tables for t in layer)
    inputs = sum(len(tup) for m in network.mappings for tup in m.of(""))
    return -(-entries // 8) + 4 * inputs
