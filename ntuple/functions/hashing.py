"""Hash families of the Bloom models as column expressions over a tuple address.

All of them take the integer address (bit ``j`` of the address is digit ``j`` of the key)
so that they run on distinct addresses of a model or of a scored table, not on raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import constant, let
from .scalars import md5_int

MASK = (1 << 32) - 1

# Constants of the public 32-bit Murmur3 hash.
C1 = 0xCC9E2D51
C2 = 0x1B873593
ADD = 0xE6546B64
MIX1 = 0x85EBCA6B
MIX2 = 0xC2B2AE35


def _mul32(a: Column, b: int) -> Column:
    """a * b mod 2**32 without leaving the signed 64-bit range."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)
    high = (F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK))


def _rotl(a: Column, r: int) -> Column:
    return (a * F.lit(1 << r)).bitwiseAND(F.lit(MASK)).bitwiseOR(F.shiftright(a, 32 - r))


def _scramble(k: Column) -> Column:
    return let(_mul32(k, C1), lambda m: _mul32(_rotl(m, 15), C2))


def _finish(h: Column, length: int) -> Column:
    h = h.bitwiseXOR(F.lit(length))
    h = let(h, lambda v: _mul32(v.bitwiseXOR(F.shiftright(v, 16)), MIX1))
    h = let(h, lambda v: _mul32(v.bitwiseXOR(F.shiftright(v, 13)), MIX2))
    return let(h, lambda v: v.bitwiseXOR(F.shiftright(v, 16)))


def murmur32(blocks: Column, seed: Column, length: int, tail: Column | None = None) -> Column:
    """32-bit Murmur3 of little-endian 4-byte ``blocks`` (array<bigint>) plus an optional tail."""
    h = F.aggregate(
        F.transform(blocks, _scramble),
        seed.cast("bigint"),
        lambda acc, k: let(
            acc.bitwiseXOR(k),
            lambda v: (_rotl(v, 13) * 5 + F.lit(ADD)).bitwiseAND(F.lit(MASK)),
        ),
    )
    if tail is not None:
        h = h.bitwiseXOR(_scramble(tail))
    return _finish(h, length)


def address_digits(address: Column, n: int) -> Column:
    """The bits of an address, digit 0 first."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda j: F.getbit(address, j).cast("bigint"),
    )


def murmur_slots(address: Column, n: int, n_slots: int, n_hashes: int) -> Column:
    """Double hashing: slot i = (h1 + i*h2 mod 2**32) mod n_slots, one 4-byte word per digit."""

    def slots(h1: Column) -> Column:
        h2 = murmur32(address_digits(address, n), h1, 4 * n)
        return let(
            h2,
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(n_hashes - 1)),
                lambda i: ((h1 + i * h).bitwiseAND(F.lit(MASK)) % F.lit(n_slots)).cast("int"),
            ),
        )

    return let(murmur32(address_digits(address, n), F.lit(0), 4 * n), slots)


def h3_constants(n: int, n_hashes: int, seed: int) -> list[list[int]]:
    return [[md5_int(f"h3:{seed}:{i}:{j}") for j in range(n)] for i in range(n_hashes)]


def h3_slots(address: Column, constants: list[list[int]], n_slots: int) -> Column:
    """Per hash: XOR of the constants of the set digits, mod n_slots."""

    def one(row: list[int]) -> Column:
        picked = [
            F.getbit(address, F.lit(j)).cast("bigint") * F.lit(c).cast("bigint")
            for j, c in enumerate(row)
        ]
        return (reduce(lambda a, b: a.bitwiseXOR(b), picked) % F.lit(n_slots)).cast("int")

    return F.array(*[one(row) for row in constants])


def hyperplanes(n: int, seed: int) -> list[list[int]]:
    """±1 planes of the similarity signature, at least 64 of them."""
    return [
        [1 if md5_int(f"sim:{seed}:{h}:{d}", 1) % 2 == 0 else -1 for d in range(n)]
        for h in range(max(64, 2 * n))
    ]


def simhash_slots(address: Column, n: int, n_slots: int, n_hashes: int, seed: int) -> Column:
    """Sign signature of the key, then Murmur3 of its bytes with seeds 1..n_hashes."""
    planes = hyperplanes(n, seed)
    n_bytes = (len(planes) + 7) // 8
    whole, rest = divmod(n_bytes, 4)
    table = constant(planes, "array<array<int>>")

    def positions(sig: Column) -> Column:
        def word(start: Column, count: int) -> Column:
            return F.aggregate(
                F.reverse(F.slice(sig, start + 1, count)),
                F.lit(0).cast("bigint"),
                lambda acc, b: acc * 2 + b,
            )

        blocks = F.transform(F.sequence(F.lit(0), F.lit(whole - 1)), lambda w: word(w * 32, 32))
        tail = word(F.lit(whole * 32), len(planes) - whole * 32) if rest else None
        return F.transform(
            F.sequence(F.lit(1), F.lit(n_hashes)),
            lambda s: (murmur32(blocks, s, n_bytes, tail) % F.lit(n_slots)).cast("int"),
        )

    signature = let(
        address_digits(address, n),
        lambda key: F.transform(
            table,
            lambda plane: F.when(
                F.aggregate(
                    F.zip_with(plane, key, lambda p, k: p * k),
                    F.lit(0).cast("bigint"),
                    lambda acc, v: acc + v,
                )
                >= 0,
                F.lit(1),
            ).otherwise(F.lit(0)),
        ),
    )
    return let(signature, positions)
