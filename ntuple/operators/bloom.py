"""Counting Bloom filters as tuple memories: the model is ``(label, ram_id, slot, cnt)``.

Hashing happens on distinct addresses: training first counts addresses (a map-side
combine) and only then hashes them, and scoring first *resolves* the filter into counts of
the addresses that are needed, after which the counting classifier does the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import h3_constants, h3_slots, murmur_slots, simhash_slots
from ..functions.joins import lookup_join
from .address import BitSource, Mapping, tuple_rows
from .count_model import CountModel, Options, class_counts, count_addresses

@dataclass(frozen=True)
class HashFamily:
    """``n_hashes`` slots in ``[0, n_slots)``; mode murmur, h3 or simhash."""

    mode: str = "murmur"
    n_slots: int = 1024
    n_hashes: int = 3
    seed: int = 1

    def slots(self, address: Column, n: int) -> Column:
        if self.mode == "murmur":
            return murmur_slots(address, n, self.n_slots, self.n_hashes)
        if self.mode == "h3":
            return h3_slots(address, h3_constants(n, self.n_hashes, self.seed), self.n_slots)
        if self.mode == "simhash":
            return simhash_slots(address, n, self.n_slots, self.n_hashes, self.seed)
        raise ValueError(f"unknown hash mode {self.mode}")


@dataclass(frozen=True)
class BloomModel:
    table: DataFrame
    mapping: Mapping
    trainings: dict[str, int]
    hashes: HashFamily
    ignore_zero: bool = False
    options: Options = Options()

    @staticmethod
    def train(
        df: DataFrame,
        mapping: Mapping | Callable[[list[str]], Mapping],
        bits: BitSource,
        label: str = "label",
        hashes: HashFamily = HashFamily(),
        ignore_zero: bool = False,
        options: Options = Options(),
    ) -> BloomModel:
        """Count slot hits per label and tuple; with ``ignore_zero`` the zero key is skipped."""
        trainings = class_counts(df, label)
        chosen = mapping if isinstance(mapping, Mapping) else mapping(list(trainings))
        _check(chosen)
        counts = count_addresses(df, chosen, bits, label)
        if ignore_zero:
            counts = counts.where(F.col("address") != 0)
        table = (
            counts.select(
                "label",
                "ram_id",
                F.explode(hashes.slots(F.col("address"), chosen.widest)).alias("slot"),
                "cnt",
            )
            .groupBy("label", "ram_id", "slot")
            .agg(F.sum("cnt").alias("cnt"))
        )
        return BloomModel(table, chosen, trainings, hashes, ignore_zero, options)

    @property
    def labels(self) -> list[str]:
        return list(self.trainings)

    def slot_hits(self, addresses: DataFrame) -> DataFrame:
        """Per address, label and hash: the counter, 0 where never counted.

        ``addresses`` has ``(ram_id, address)`` and, for per-label mappings, ``label``.
        """
        keys = ["ram_id"] if self.mapping.is_shared else ["label", "ram_id"]
        hashed = addresses.select(
            *keys,
            "address",
            F.posexplode(self.hashes.slots(F.col("address"), self.mapping.widest)).alias(
                "hash", "slot"
            ),
        )
        if self.mapping.is_shared:
            # label x hash fan-out on distinct addresses only
            hashed = hashed.select(
                F.explode(F.array(*[F.lit(lab) for lab in self.labels])).alias("label"), "*"
            )
        hits = lookup_join(hashed, self.table, ["label", "ram_id", "slot"], ["address", "hash"])
        return hits.withColumn("cnt", F.coalesce("cnt", F.lit(0)))

    def resolve(self, addresses: DataFrame) -> DataFrame:
        """Smallest counter over the hashes for each address: ``(label, ram_id, address, cnt)``."""
        hits = self.slot_hits(addresses)
        if self.ignore_zero:
            hits = hits.where(F.col("address") != 0)
        return (
            hits.groupBy("label", "ram_id", "address")
            .agg(F.min("cnt").alias("cnt"))
            .where(F.col("cnt") > 0)
        )

    def membership(self, addresses: DataFrame) -> DataFrame:
        """Per address and label: is it (probably) known, and how many slots are set."""
        hits = self.slot_hits(addresses)
        live = F.lit(True) if not self.ignore_zero else F.col("address") != 0
        return hits.groupBy("label", "ram_id", "address").agg(
            (F.min("cnt") > 0).alias("known"),
            F.min("cnt").alias("min_count"),
            F.sum(F.when((F.col("cnt") > 0) & live, 1).otherwise(0)).alias("soft_vote"),
        )

    def needed_addresses(self, df: DataFrame, bits: BitSource) -> DataFrame:
        """Distinct addresses of the rows to score."""
        return tuple_rows(df, self.mapping, bits, []).distinct()

    def as_count_model(self, df: DataFrame, bits: BitSource) -> CountModel:
        """A counting classifier that answers with this filter's counters for the rows of ``df``.

        Other rows may have addresses that were not resolved: call it for the rows to be scored.
        """
        addresses = self.needed_addresses(df, bits)
        return CountModel(self.resolve(addresses), self.mapping, self.trainings, self.options)

    def size_bytes(self, per_class: bool = True) -> int:
        """One bit per slot; ``per_class=False`` counts one discriminator only."""
        rams = self.mapping.n_rams * (len(self.labels) if per_class else 1)
        return -(-rams * self.hashes.n_slots // 8)


def _check(mapping: Mapping) -> None:
    if mapping.base != 2 or mapping.is_wide:
        raise ValueError("hashed tuples are binary and at most 62 bits wide")
    if len({len(t) for tuples in mapping.tuples.values() for t in tuples}) != 1:
        raise ValueError("hashed tuples need one common size")
