"""Document fingerprints by consistent weighted sampling.

Native.  The terms of a text are its words, weighted by how often they occur.  For each sample
and term, ``r`` and ``c`` are Gamma(2, 1) and ``beta`` is uniform, drawn from a hash of the two
alone.  With ``t = floor(ln(weight) / r + beta)`` and ``ln a = ln c - r (t - beta) - r`` the
sample is the term with the least ``a``, together with its ``t``.  Two texts agree in a sample with a
probability that is their generalised Jaccard similarity: the sum of the lesser weights
over the sum of the greater ones.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD

SAMPLES = 64
#: Quantiles by which a Gamma variate is drawn from 12 bits of a hash.
QUANTILE_BITS = 12
#: Bits of a sample in the fingerprint; different samples look equal once in 2^16.
SAMPLE_BITS = 16
DIGITS = SAMPLE_BITS // 4


@cache
def gamma_quantiles() -> tuple[float, ...]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    n, out, x = 1 << QUANTILE_BITS, [], 0.01
    for i in range(n):
        p = (i + 0.5) / n
        low, high = 0.0, 40.0
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
        out.append(x)
    return tuple(out)


def quantile_table(spark: SparkSession) -> DataFrame:
    """One row: ``_one``, ``_r`` and ``_lnc``, the quantiles and their logarithms."""
    q = gamma_quantiles()
    text = ",".join(f"{x:.17g}" for x in q)
    values = F.transform(F.split(F.lit(text), ","), lambda x: x.cast("double"))
    return spark.range(1, numPartitions=1).select(
        F.lit(1).alias("_one"), values.alias("_r"), F.transform(values, lambda x: F.ln(x)).alias("_lnc")
    )


def sample_key(i: int, term: str = "_term", log_weight: str = "_lnw") -> Column:
    """The rank of a term in sample ``i``, least first; its low 28 bits name the term and ``t``."""
    h = F.xxhash64(term, F.lit(i))
    mask = F.lit((1 << QUANTILE_BITS) - 1)
    r = F.get("_r", h.bitwiseAND(mask).cast("int"))
    ln_c = F.get("_lnc", F.shiftrightunsigned(h, 12).bitwiseAND(mask).cast("int"))
    beta = F.shiftrightunsigned(h, 24).bitwiseAND(F.lit(0xFFFFF)) / F.lit(float(1 << 20))
    t = F.floor(F.col(log_weight) / r + beta)
    ln_a = ln_c - r * (t - beta) - r
    rank = ((ln_a + 64.0) * F.lit(float(1 << 24))).cast("long")
    name = F.shiftrightunsigned(h, 36).bitwiseXOR(t * 0x9E3779).bitwiseAND(F.lit((1 << 28) - 1))
    return F.shiftleft(rank, 28).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` for each row; ``keys`` identify it.

    A fingerprint has :data:`DIGITS` hexadecimal digits for each of :data:`SAMPLES` samples; that of a
    text without words (null, empty or blank) is empty.  Where ``texts`` is already partitioned by some
    of ``keys``, nothing is shuffled.  Words are counted over the whole text, however long.  Rows
    that share all keys are one text; no rows give no rows; other columns are not read.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    # A text without words keeps a row whose word is null.
    hashed = texts.select(*keys, F.explode_outer(words).alias("_word")).select(
        *keys, F.when(F.col("_word").isNotNull(), F.xxhash64("_word")).alias("_term")
    )
    terms = hashed.groupBy(*keys, "_term").agg(F.ln(F.count(F.lit(1)).cast("double")).alias("_lnw")).withColumn("_one", F.lit(1))
    tables = F.broadcast(quantile_table(texts.sparkSession))
    mins = [F.min(sample_key(i)).alias(f"_m{i}") for i in range(SAMPLES)]
    signed = terms.join(tables, "_one").groupBy(*keys).agg(F.count("_term").alias("_n"), *mins)
    low = F.lit((1 << SAMPLE_BITS) - 1)
    digits = [F.lpad(F.hex(F.col(f"_m{i}").bitwiseAND(low)), DIGITS, "0") for i in range(SAMPLES)]
    return signed.select(*keys, F.when(F.col("_n") > 0, F.concat(*digits)).otherwise("").alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of the samples in which two fingerprints agree; 1 for two empty ones, 0 for one."""
    same = [F.when(F.substring(a, 1 + i * DIGITS, DIGITS) == F.substring(b, 1 + i * DIGITS, DIGITS), 1).otherwise(0) for i in range(SAMPLES)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(total / F.lit(float(SAMPLES)))
