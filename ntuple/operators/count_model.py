"""Counting classifier: the model is the table ``(label, ram_id, address, cnt)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import constant, let
from ..functions.joins import lookup_join
from . import decide
from .address import (
    SHARED,
    BitSource,
    Mapping,
    address_pattern,
    class_counts,
    slot_count,
    slot_numbers,
    slot_offsets,
    slot_votes,
    tuple_rows,
)

DENSE_CELLS = 1 << 18
"""Largest dense vote table (slots x labels) that becomes a constant of the plan."""


def check_entry_size(df: DataFrame, bits: str, entry_size: int) -> None:
    """Fail unless every row has ``entry_size`` bits."""
    low, high = df.agg(F.min(F.size(bits)), F.max(F.size(bits))).first()
    if low is not None and (low != entry_size or high != entry_size):
        raise ValueError(f"entries of {low} to {high} bits, expected {entry_size}")


def count_addresses(df: DataFrame, mapping: Mapping, bits: BitSource, label: str = "label") -> DataFrame:
    """Training: one map-side-combined count per (label, tuple, address)."""
    labelled = df.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("string"))
    if not mapping.is_shared:
        unmapped = F.concat(F.lit("no mapping for the label "), F.col(label))
        known = F.col(label).isin(sorted(mapping.tuples))
        labelled = labelled.withColumn(label, F.when(known, F.col(label)).otherwise(F.raise_error(unmapped).cast("string")))
    rows = tuple_rows(labelled, mapping, bits, [label], label=label)
    return (
        rows.groupBy(F.col(label).alias("label"), "ram_id", "address")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Add up models (incremental training)."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t)
    return merged.groupBy("label", "ram_id", "address").agg(F.sum("cnt").alias("cnt"))


def subtract_counts(table: DataFrame, removed: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Forget rows: counts of known keys go down; keys at or below zero are dropped."""
    signed = table.select("label", "ram_id", "address", "cnt", F.lit(1).alias("known")).unionByName(
        removed.select("label", "ram_id", "address", (-F.col("cnt")).alias("cnt"), F.lit(0).alias("known"))
    )
    out = signed.groupBy("label", "ram_id", "address").agg(
        F.sum("cnt").alias("cnt"), F.max("known").alias("known")
    )
    out = out.where(F.col("known") == 1).drop("known")
    return out if keep_zero else out.where(F.col("cnt") > 0)


@dataclass(frozen=True)
class Options:
    """What happens between votes and scores; the defaults change nothing."""

    ignore_zero: bool = False
    balanced: bool = False
    weights: dict[str, list[float]] | None = None
    attention: bool = False
    cross_class: bool = False
    rule: decide.Rule = decide.bleaching
    soft: bool = False
    background_beta: float | None = None
    negative_alpha: float | None = None
    negative_mode: str = "uniform"


@dataclass(frozen=True)
class CountModel:
    table: DataFrame
    mapping: Mapping
    trainings: dict[str, int]
    options: Options = field(default_factory=Options)
    background: DataFrame | None = None
    """Counts over all rows regardless of label: ``(ram_id, address, cnt)``."""
    background_mapping: Mapping | None = None
    """The shared mapping of the background."""
    new_mapping: Callable[[list[str]], Mapping] | None = None
    """Makes the tuples of labels that are trained later."""

    @staticmethod
    def train(
        df: DataFrame,
        mapping: Mapping | Callable[[list[str]], Mapping],
        bits: BitSource,
        label: str = "label",
        options: Options = Options(),
        background: Mapping | None = None,
    ) -> CountModel:
        """Count addresses.  ``mapping`` may be a function of the labels found in ``df``."""
        trainings = class_counts(df, label)
        maker = None if isinstance(mapping, Mapping) else mapping
        chosen = mapping if maker is None else maker(list(trainings))
        _check_labels(chosen, trainings)
        shared = None if background is None else count_background(df, background, bits, label)
        return CountModel(
            count_addresses(df, chosen, bits, label), chosen, trainings, options, shared, background, maker
        )

    @property
    def labels(self) -> list[str]:
        return list(self.trainings)

    def with_options(self, **changes) -> CountModel:
        return replace(self, options=replace(self.options, **changes))

    def add(self, df: DataFrame, bits: BitSource, label: str = "label") -> CountModel:
        """Train more rows, in the background as well.

        A label that the model does not know yet gets tuples from ``new_mapping``; a shared
        mapping covers every label.
        """
        counts = dict(self.trainings)
        for lab, n in class_counts(df, label).items():
            counts[lab] = counts.get(lab, 0) + n
        mapping = self.mapping
        fresh = [] if mapping.is_shared else sorted(set(counts) - set(mapping.tuples))
        if fresh and self.new_mapping is not None:
            made = self.new_mapping(fresh)
            for lab in fresh:
                mapping = mapping.replaced(lab, made.of(lab))
        _check_labels(mapping, counts)
        background = self.background
        if background is not None:
            more = count_background(df, self.background_mapping, bits, label)
            background = _merged(background.unionByName(more))
        return replace(
            self,
            table=merge_counts(self.table, count_addresses(df, mapping, bits, label)),
            mapping=mapping,
            trainings=dict(sorted(counts.items(), key=lambda kv: kv[0].encode())),
            background=background,
        )

    def remove(self, df: DataFrame, bits: BitSource, label: str = "label", keep_zero: bool = False) -> CountModel:
        """Forget rows, in the background as well; labels the model does not know are ignored."""
        known = df.where(F.col(label).cast("string").isin(self.labels))
        counts = dict(self.trainings)
        for lab, n in class_counts(known, label).items():
            counts[lab] -= n
        background = self.background
        if background is not None:
            less = count_background(known, self.background_mapping, bits, label)
            left = _merged(background.unionByName(less.withColumn("cnt", -F.col("cnt"))))
            background = left if keep_zero else left.where(F.col("cnt") > 0)
        return replace(
            self,
            table=subtract_counts(
                self.table, count_addresses(known, self.mapping, bits, label), keep_zero
            ),
            trainings=counts,
            background=background,
        )

    def reset(self) -> CountModel:
        """Drop the contents, keep mapping and labels."""
        return replace(
            self,
            table=self.table.where(F.lit(False)),
            trainings={lab: 0 for lab in self.trainings},
            background=None if self.background is None else self.background.where(F.lit(False)),
        )

    # -- votes --------------------------------------------------------------

    def is_dense(self) -> bool:
        if self.mapping.is_wide:
            return False
        factor = len(self.labels) if self.mapping.is_shared else 1
        return slot_count(self.mapping, self.labels) * factor <= DENSE_CELLS

    def dense_cells(self) -> Column:
        """The whole model as one constant; only for models with a small address space."""
        if not self.is_dense():
            raise ValueError("the address space is too large for a constant")
        offsets = slot_offsets(self.mapping, self.labels)
        place = {lab: i for i, lab in enumerate(self.labels)}
        n = slot_count(self.mapping, self.labels)
        rows = self.table.where(F.col("label").isin(self.labels)).collect()
        if self.mapping.is_shared:
            cells = [[0] * len(self.labels) for _ in range(n)]
            for r in rows:
                cells[offsets[(SHARED, r["ram_id"])] + r["address"]][place[r["label"]]] = r["cnt"]
            return constant(cells, "array<array<bigint>>")
        flat = [0] * n
        for r in rows:
            flat[offsets[(r["label"], r["ram_id"])] + r["address"]] = r["cnt"]
        return constant(flat, "array<bigint>")

    def _zero_slots(self) -> Column:
        """Dense positions of the zero addresses."""
        return constant(sorted(slot_offsets(self.mapping, self.labels).values()), "array<int>")

    def _votes_at(self, slots: Column) -> Column:
        if not self.options.ignore_zero:
            return slot_votes(self.mapping, self.labels, self.dense_cells(), slots)
        silent = self._zero_slots()
        masked = F.transform(
            slots, lambda s: F.when(F.array_contains(silent, s), F.lit(-1)).otherwise(s)
        )
        votes = slot_votes(self.mapping, self.labels, self.dense_cells(), masked)
        if self.mapping.is_shared:
            nothing = F.array_repeat(F.lit(0).cast("bigint"), len(self.labels))
            return F.transform(votes, lambda row: F.coalesce(row, nothing))
        return F.transform(votes, lambda row: F.transform(row, lambda v: F.coalesce(v, F.lit(0).cast("bigint"))))

    def votes_in_row(self, df: DataFrame, bits: BitSource, name: str = "votes") -> DataFrame:
        """Votes from the dense constant: a projection, no shuffle and no row key."""
        slots = slot_numbers(self.mapping, bits, self.labels)
        return df.withColumn(name, let(slots, self._votes_at))

    def votes_by_pattern(self, df: DataFrame, bits: BitSource, keep: list[str]) -> DataFrame:
        """``(keep..., n, votes)``: rows with equal ``keep`` and equal addresses counted as one.

        Decisions depend on the addresses only, so summaries over rows (confusion counts,
        accuracies, tuple weights) need each pattern once; the count is combined map-side.
        """
        slots = slot_numbers(self.mapping, bits, self.labels)
        counted = (
            df.select(*keep, slots.alias("_slots"))
            .groupBy(*keep, "_slots")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        return counted.select(*keep, "n", self._votes_at(F.col("_slots")).alias("votes"))

    def confusion(self, df: DataFrame, bits: BitSource, label: str = "label") -> DataFrame:
        """Rows per label and prediction: ``(label, predicted, n)``."""
        if self.is_dense() and not self.uses_background:
            voted = self.votes_by_pattern(df, bits, [label])
            won = decide.winner(self.scores(F.col("votes")), self.labels)
            voted = voted.select(F.col(label).alias("label"), won.alias("predicted"), "n")
        else:
            voted = self.classify(df, bits).select(F.col(label).alias("label"), "predicted", F.lit(1).alias("n"))
        return voted.groupBy("label", "predicted").agg(F.sum("n").alias("n"))

    def votes_by_join(
        self, df: DataFrame, bits: BitSource, name: str = "votes", broadcast: bool = True
    ) -> DataFrame:
        """Votes by an equi-join of addresses with the model table.

        Rows with the same addresses get the same votes, so each distinct pattern of addresses is
        looked up once and joined back: every input row, repeated ones included, comes out once
        with all its columns, and no row key is needed.  The model is broadcast only when its
        address space proves it small (and ``broadcast`` allows it); otherwise both sides shuffle
        on the address plus a salt.
        """
        shared, n_labels = self.mapping.is_shared, len(self.labels)
        per_tuple = 1 if shared else n_labels
        pattern = address_pattern(self.mapping, bits, self.labels)
        # Two hashes name a pattern; the addresses themselves may be long.
        marked = df.withColumn("_pattern", pattern).withColumns(
            {"_p1": F.xxhash64("_pattern"), "_p2": F.hash("_pattern")}
        )
        patterns = marked.select("_p1", "_p2", "_pattern").dropDuplicates(["_p1", "_p2"])
        place = ["_p1", "_p2"]
        lookups = patterns.select(*place, F.posexplode("_pattern").alias("_at", "address")).withColumn(
            "ram_id", F.floor(F.col("_at") / per_tuple).cast("int")
        )
        keys = ["ram_id", "address"]
        if shared:
            own = [F.coalesce(F.sum(F.when(F.col("label") == lab, F.col("cnt"))), F.lit(0)) for lab in self.labels]
            model = self.table.groupBy(*keys).agg(F.array(*own).alias("counts"))
        else:
            names = constant(self.labels, "array<string>")
            lookups = lookups.withColumn("label", F.get(names, (F.col("_at") % per_tuple).cast("int")))
            keys = ["label", *keys]
            model = self.table.select(*keys, F.array(F.col("cnt")).alias("counts"))
        if broadcast is False or self.mapping.is_wide:
            proven = None
        else:
            proven = slot_count(self.mapping, self.labels) * (48 + 8 * n_labels)
        joined = lookup_join(lookups, model, keys, ["_p1", "_at"], proven)
        missing = F.array_repeat(F.lit(0).cast("bigint"), n_labels if shared else 1)
        found = F.coalesce(F.col("counts"), missing)
        if self.options.ignore_zero:
            zero = F.lit("0" * self.mapping.widest) if self.mapping.is_wide else F.lit(0)
            found = F.when(F.col("address") == zero, missing).otherwise(found)
        entries = F.transform(F.array_sort(F.collect_list(F.struct("_at", found.alias("v")))), lambda e: e["v"])
        if shared:
            votes = entries
        else:
            rams = constant(list(range(self.mapping.n_rams)), "array<int>")
            votes = let(
                F.flatten(entries),
                lambda flat: F.transform(rams, lambda r: F.slice(flat, r * n_labels + 1, n_labels)),
            )
        voted = joined.groupBy(*place).agg(votes.alias(name))
        # Many rows may share a pattern; its votes are one row.
        return lookup_join(marked, voted, place, how="inner").select(*[c for c in df.columns if c != name], name)

    def votes(self, df: DataFrame, bits: BitSource, name: str = "votes") -> DataFrame:
        """Add votes, by whichever way the size of the address space allows; the result is the same."""
        return self.votes_in_row(df, bits, name) if self.is_dense() else self.votes_by_join(df, bits, name)

    @property
    def uses_background(self) -> bool:
        return self.background is not None and self.options.background_beta is not None

    def with_background(self, df: DataFrame, bits: BitSource) -> DataFrame:
        """Add ``background``: how many tuples of a row the background model has seen."""
        everything = CountModel(
            self.background.select(F.lit("").alias("label"), "ram_id", "address", "cnt"),
            self.background_mapping or self.mapping,
            {"": 1},
        )
        voted = everything.votes(df, bits, "_seen")
        hits = F.size(F.filter("_seen", lambda row: F.get(row, F.lit(0)) > 0))
        return voted.withColumn("background", hits).drop("_seen")

    # -- decisions ----------------------------------------------------------

    def reweighted(self, votes: Column) -> Column:
        o, labels = self.options, self.labels
        if o.balanced:
            votes = decide.balanced_votes(votes, [self.trainings[lab] for lab in labels])
        if self.mapping.multi_resolution:
            sizes = [self.mapping.sizes(lab if not self.mapping.is_shared else SHARED) for lab in labels]
            votes = decide.scaled_votes(votes, [list(r) for r in zip(*sizes, strict=True)], "int")
        if o.weights is not None:
            weights = [o.weights.get(lab, [1.0] * self.mapping.n_rams) for lab in labels]
            votes = decide.scaled_votes(votes, [list(r) for r in zip(*weights, strict=True)])
        if o.attention:
            votes = decide.attention_votes(votes, len(labels))
        if o.cross_class:
            votes = decide.cross_class_votes(votes, len(labels))
        return votes

    def scores(self, votes: Column, background_hits: Column | None = None) -> Column:
        """Votes to one score per label, in label order."""
        o, n = self.options, len(self.labels)
        reweighted = self.reweighted(votes)
        if o.soft:
            out = decide.bleaching(reweighted, n, score=decide.excess_above)
        else:
            out = o.rule(reweighted, n)
        if o.background_beta is not None and background_hits is not None:
            out = decide.subtract_background(out, background_hits, o.background_beta)
        if o.negative_alpha is not None:
            out = decide.negative_evidence(out, o.negative_alpha, o.negative_mode)
        return out

    def _scored(self, df: DataFrame, bits: BitSource) -> tuple[DataFrame, Column]:
        voted = self.votes(df, bits)
        if not self.uses_background:
            return voted, self.scores(F.col("votes"))
        return self.with_background(voted, bits), self.scores(F.col("votes"), F.col("background"))

    def rank(self, df: DataFrame, bits: BitSource) -> DataFrame:
        """Add ``votes`` and ``scores``, an array in label order."""
        voted, scores = self._scored(df, bits)
        return voted.withColumn("scores", scores)

    def classify(self, df: DataFrame, bits: BitSource) -> DataFrame:
        """Add ``votes`` and ``predicted``."""
        voted, scores = self._scored(df, bits)
        return voted.withColumn("predicted", decide.winner(scores, self.labels))


def _check_labels(mapping: Mapping, trainings: dict[str, int]) -> None:
    missing = [] if mapping.is_shared else sorted(set(trainings) - set(mapping.tuples))
    if missing:
        raise ValueError(f"no mapping for the labels {missing[:5]}")


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("ram_id", "address").agg(F.sum("cnt").alias("cnt"))


def count_background(df: DataFrame, mapping: Mapping, bits: BitSource, label: str = "label") -> DataFrame:
    """Counts of all labelled rows regardless of label: ``(ram_id, address, cnt)``."""
    rows = tuple_rows(df.where(F.col(label).isNotNull()), mapping, bits, [])
    return rows.groupBy("ram_id", "address").agg(F.count(F.lit(1)).alias("cnt"))


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    hit = F.when(F.col(predicted) == F.col(label), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))

