"""Small building blocks for column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Collapsed projections would otherwise copy a computed array into every lambda call
    that reads it and evaluate it again each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value: object, schema: str) -> Column:
    """A nested constant; folded to one literal when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def bit(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` of doubles, which nothing ends: over zero it is infinite, zero over zero NaN."""
    over_zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def truncate(value: Column) -> Column:
    """Drop the fraction, towards zero."""
    return value.cast("bigint")


def pack_bits(bits: Column) -> Column:
    """Bit array to bytes: the number of padding bits, then the bits, highest of a byte first."""

    def packed(b: Column) -> Column:
        pad = F.pmod(-F.size(b), F.lit(8))
        return let(
            F.concat(b, F.array_repeat(F.lit(0), pad)),
            lambda p: F.concat(
                F.lpad(F.hex(pad), 2, "0"),
                F.array_join(
                    F.transform(
                        F.sequence(F.lit(0), F.floor(F.size(p) / 8).cast("int") - 1),
                        lambda i: F.lpad(
                            F.hex(F.aggregate(F.slice(p, i * 8 + 1, 8), F.lit(0), lambda n, x: n * 2 + x)),
                            2,
                            "0",
                        ),
                    ),
                    "",
                ),
            ),
        )

    return F.unhex(let(bits.cast("array<int>"), packed))


def unpack_bits(data: Column) -> Column:
    """Inverse of :func:`pack_bits`."""

    def byte(digits: Column, i: Column) -> Column:
        return F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def unpacked(digits: Column) -> Column:
        size = F.floor(F.length(digits) / 2).cast("int") * 8 - 8 - byte(digits, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), size - 1),
            lambda i: F.getbit(
                byte(digits, F.floor(i / 8).cast("int") + 1), 7 - F.pmod(i, F.lit(8))
            ).cast("tinyint"),
        )

    return let(F.hex(data), unpacked)
