"""Regression memories: per tuple address the number of rows and the sum of their targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join
from ..session import cut_lineage
from .address import BitSource, Mapping, slot_count, tuple_rows

Mean = Callable[[Column, Column], Column]
"""Aggregate over the tuples of a row: (count, sum of targets) columns to one value."""


def _hit(cnt: Column) -> Column:
    return cnt > 0


def _average(cnt: Column, total: Column) -> Column:
    return F.when(_hit(cnt), total / cnt)


def ratio_mean(cnt: Column, total: Column) -> Column:
    """Sum of sums over sum of counts."""
    return F.when(F.sum(cnt) > 0, F.sum(total) / F.sum(cnt)).otherwise(F.lit(0.0))


def _ratio_of_arrays(cnt: np.ndarray, total: np.ndarray) -> np.ndarray:
    n = cnt.sum(axis=1)
    return np.where(n > 0, total.sum(axis=1) / np.maximum(n, 1), 0.0)


def by_arrays(mean: Mean) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """The mean over the rows of two arrays ``(row, tuple)``, if it has such a form."""
    return {ratio_mean: _ratio_of_arrays}.get(mean)


def power_mean(p: float) -> Mean:
    def mean(cnt: Column, total: Column) -> Column:
        return F.coalesce(F.pow(F.avg(F.pow(_average(cnt, total), F.lit(p))), F.lit(1.0 / p)), F.lit(0.0))

    return mean


def median_mean(cnt: Column, total: Column) -> Column:
    """Median of the address means that were seen."""
    return F.coalesce(F.percentile(_average(cnt, total), 0.5), F.lit(0.0))


def _nonzero(cnt: Column, total: Column) -> Column:
    m = _average(cnt, total)
    return F.when(m != 0, m)


def harmonic_mean(cnt: Column, total: Column) -> Column:
    m = _nonzero(cnt, total)
    return F.coalesce(F.count(m) / F.sum(1 / m), F.lit(0.0))


def harmonic_power_mean(p: float) -> Mean:
    def mean(cnt: Column, total: Column) -> Column:
        m = _nonzero(cnt, total)
        return F.coalesce(F.pow(F.count(m) / F.sum(F.pow(m, F.lit(-p))), F.lit(1.0 / p)), F.lit(0.0))

    return mean


def geometric_mean(cnt: Column, total: Column) -> Column:
    m = _nonzero(cnt, total)
    return F.when(F.count(m) > 0, F.pow(F.product(m), 1 / F.count(m))).otherwise(F.lit(0.0))


def exponential_mean(cnt: Column, total: Column) -> Column:
    """ln((1 + sum of exp(mean)) / number of means)."""
    m = _average(cnt, total)
    return F.when(F.count(m) > 0, F.log((1 + F.sum(F.exp(m))) / F.count(m))).otherwise(F.lit(0.0))


def logistic_mean(b1: float, b2: float, g: float) -> Mean:
    """1 / (1 + exp(-(b1 * average + b2 * share of tuples hit + g)))."""

    def mean(cnt: Column, total: Column) -> Column:
        m = _average(cnt, total)
        z = b1 * F.avg(m) + b2 * F.count(m) / F.count(F.lit(1)) + g
        return F.when(F.count(m) > 0, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))

    return mean


@dataclass(frozen=True)
class RegressionModel:
    """``table`` is ``(ram_id, address, cnt, sum_y)``."""

    table: DataFrame
    mapping: Mapping
    mean: Mean = ratio_mean
    min_zero: int = 0
    min_one: int = 0

    @staticmethod
    def train(
        df: DataFrame,
        mapping: Mapping,
        bits: BitSource,
        y: str = "y",
        mean: Mean = ratio_mean,
        min_zero: int = 0,
        min_one: int = 0,
        ignore_zero: bool = False,
    ) -> RegressionModel:
        """Count rows and add up targets per address; ``ignore_zero`` means ``min_zero=1``.

        The minima gate voting only, never training.
        """
        rows = tuple_rows(df.where(F.col(y).isNotNull()), mapping, bits, [y])
        table = rows.groupBy("ram_id", "address").agg(
            F.count(F.lit(1)).alias("cnt"), F.sum(F.col(y).cast("double")).alias("sum_y")
        )
        return RegressionModel(table, mapping, mean, 1 if ignore_zero else min_zero, min_one)

    def with_mean(self, mean: Mean) -> RegressionModel:
        """Exchange the mean without retraining."""
        return replace(self, mean=mean)

    def lookups(self, df: DataFrame, bits: BitSource, row_id: str, keep: list[str] | None = None) -> DataFrame:
        """``(row_id, keep..., ram_id, address, cnt, sum_y)``; zero where never seen or gated.

        The model is broadcast when its address space proves it small, else joined on the
        address with a salt against hot addresses.
        """
        rows = tuple_rows(df, self.mapping, bits, [row_id, *(keep or [])])
        proven = None if self.mapping.is_wide else slot_count(self.mapping, []) * 64
        joined = lookup_join(rows, self.table, ["ram_id", "address"], [row_id, "ram_id"], proven)
        live = F.lit(True)
        if self.min_one or self.min_zero:
            sizes = self.mapping.sizes()
            size = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("ram_id") + 1)
            ones = (
                F.length(F.regexp_replace("address", "0", ""))
                if self.mapping.is_wide
                else F.bit_count("address")
            )
            live = (ones >= self.min_one) & (size - ones >= self.min_zero)
        return joined.select(
            row_id,
            *(keep or []),
            "ram_id",
            "address",
            F.when(live, F.coalesce("cnt", F.lit(0))).otherwise(F.lit(0)).alias("cnt"),
            F.when(live, F.coalesce("sum_y", F.lit(0.0))).otherwise(F.lit(0.0)).alias("sum_y"),
        )

    def predict(self, df: DataFrame, bits: BitSource, row_id: str, keep: list[str] | None = None) -> DataFrame:
        """``(row_id, keep..., prediction)``, one partially combined aggregate per row."""
        hits = self.lookups(df, bits, row_id, keep)
        return hits.groupBy(row_id, *(keep or [])).agg(
            self.mean(F.col("cnt"), F.col("sum_y")).alias("prediction")
        )

    def votes(self, df: DataFrame, bits: BitSource, row_id: str) -> DataFrame:
        """Training rows behind each tuple of each row."""
        return self.lookups(df, bits, row_id).select(row_id, "ram_id", F.col("cnt").alias("vote"))

    def refine(
        self, df: DataFrame, bits: BitSource, row_id: str, y: str = "y", steps: int = 1,
        checkpoint: bool = True,
    ) -> RegressionModel:
        """``steps`` rounds of adding the mean residual of each address to its sum.

        Each round is one regrouping per row that yields the residual next to the row's
        addresses, one map-side-combined sum by address and a join; lineage is cut after it.
        """
        model = self
        for _ in range(steps):
            hits = model.lookups(df, bits, row_id, [y])
            residual = hits.groupBy(row_id, y).agg(
                (F.col(y) - model.mean(F.col("cnt"), F.col("sum_y"))).alias("_res"),
                F.collect_list(F.struct("ram_id", "address")).alias("_cells"),
            )
            pending = (
                residual.select("_res", F.explode("_cells").alias("_c"))
                .groupBy(F.col("_c.ram_id").alias("ram_id"), F.col("_c.address").alias("address"))
                .agg(F.sum("_res").alias("_pending"))
            )
            table = model.table.join(pending, ["ram_id", "address"], "left").select(
                "ram_id",
                "address",
                "cnt",
                (F.col("sum_y") + F.coalesce(F.col("_pending") / F.col("cnt"), F.lit(0.0))).alias("sum_y"),
            )
            model = replace(model, table=cut_lineage(table) if checkpoint else table)
        return model
