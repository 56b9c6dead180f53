"""Driver-side numeric constants: normal quantiles and md5-derived pseudo-random numbers.

They are evaluated once per parameter (a handful of thresholds, kernels or hash
constants), never per row.
"""

from __future__ import annotations

import hashlib
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution function."""
    return NormalDist().inv_cdf(p)


def md5_hex(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def md5_int(text: str, digits: int = 12) -> int:
    """The leading hex digits of the md5 as an integer (48 bits by default)."""
    return int(md5_hex(text)[:digits], 16)


def md5_unit(text: str) -> float:
    """A number in [0, 1) from the md5."""
    return md5_int(text) / float(1 << 48)


def seeded_order(items, prefix: str) -> list:
    """Items ordered by the md5 of ``prefix`` and their text: a reproducible shuffle."""
    return sorted(items, key=lambda i: md5_hex(f"{prefix}:{i}"))
