"""Quality rules: a hashed n-gram log-likelihood ratio of trusted against raw text.

Words are split into pieces (letters and digits, or other signs); single pieces and pairs of
neighbours are hashed into a fixed number of buckets.  The raw multinomial counts every
document, the trusted one every document that a label calls good.  A document's score is the
mean logarithm of the ratio of the two over its pieces and pairs.  The threshold is fixed once,
from the scores of all labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, slices

BUCKET_BITS = 16
#: Added to every bucket of both multinomials.
SMOOTH = 1.0
#: Characters that Python handles at a time.
SLICE = 1_000_000
#: Labelled good documents whose ids are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Scores are counted in steps of this size for the threshold.
STEP = 0.002

PIECE = re.compile(r"\w+|[^\w\s]+")
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Bits of a word's code of which three fit one number.
CODE_BITS = 21

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType())]
)


def bucketed(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, codes and lengths of all words, and the buckets of pieces and pairs.

    Buckets come with the number of the text they belong to.
    """
    split = [t.split() for t in texts]
    counts = [len(w) for w in split]
    codes, unique = pd.factorize(np.fromiter((w for ws in split for w in ws), dtype=object, count=sum(counts)))
    decoded = [w.decode("utf-8", "replace") for w in unique]
    pieces = [PIECE.findall(w) for w in decoded]
    per_word = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    flat = np.array([p for ps in pieces for p in ps], dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(per_word)))[:-1]
    n = per_word[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - n, n) + np.repeat(first[codes], n)
    h = hashed[place]
    of_word = np.repeat(np.arange(len(texts)), counts)
    doc = np.repeat(of_word, n)
    shift = np.uint64(64 - BUCKET_BITS)
    single = h >> shift
    with np.errstate(over="ignore"):
        pair = ((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
    inside = doc[:-1] == doc[1:]
    buckets = np.concatenate((single, (pair >> shift)[inside])).astype(np.int64)
    owners = np.concatenate((doc, doc[:-1][inside]))
    chars = np.fromiter(map(len, decoded), dtype=np.int64, count=len(decoded))
    return counts, codes, chars, buckets, owners


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three words that the text has twice or more."""
    if len(codes) < 4:
        return 0
    c = codes.astype(np.int64)
    if c.max() < 1 << CODE_BITS:
        windows = (c[:-2] << 2 * CODE_BITS) | (c[1:-1] << CODE_BITS) | c[2:]
    else:
        # Three codes do not fit one number, but the number of a pair and a code do.
        _, pairs = np.unique((c[:-1] << 32) | c[1:], return_inverse=True)
        windows = (pairs[:-1] << 32) | c[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    marks = np.zeros(len(c), dtype=bool)
    for k in range(3):
        marks[k : len(c) - 2 + k] |= twice
    return int(marks.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(text))
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def counted(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets in this partition: of all texts and of those marked ``_good``."""
    raw = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    good = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for batch in batches:
        texts = texts_of(batch, text)
        marks = np.array(batch.column(batch.schema.get_field_index("_good")).to_pylist(), dtype=bool)
        for a, b in slices(texts, SLICE):
            *_, buckets, owners = bucketed(texts[a:b])
            raw += np.bincount(buckets, minlength=len(raw))
            good += np.bincount(buckets[marks[a:b][owners]], minlength=len(raw))
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(good[seen])], names=["bucket", "raw", "good"])
    released()


def scored(texts: list[bytes], ratios: np.ndarray) -> list[np.ndarray]:
    """The statistics of :data:`STATS` for some texts."""
    counts, codes, chars, buckets, owners = bucketed(texts)
    ends = np.cumsum(counts)
    n_grams = np.bincount(owners, minlength=len(texts))
    sums = np.bincount(owners, weights=ratios[buckets], minlength=len(texts))
    n_words = np.array(counts, dtype=np.int64)
    word_chars = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=chars[codes], minlength=len(texts)).astype(np.int64)
    symbols = np.array([sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))) for t in texts], dtype=np.int64)
    dup_lines = np.array([duplicate_lines(t) for t in texts], dtype=np.int64)
    repeats = np.array([repeated_words(codes[e - n : e]) for e, n in zip(ends, counts, strict=True)], dtype=np.int64)
    failed = (n_words < LEAST_WORDS) | (100 * repeats > 50 * n_words)
    return [n_words, word_chars, symbols, dup_lines, repeats, failed, sums / np.maximum(n_grams, 1)]


@dataclass(frozen=True)
class Model:
    """Log ratios of the buckets, and the score from which on documents are kept."""

    ratios: np.ndarray
    threshold: float


def with_stats(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with the columns of :data:`STATS`."""
    kept = [c for c in docs.columns if c not in STATS.names]
    rows = docs.select(*kept)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text)
            for a, b in slices(texts, SLICE):
                arrays = [pa.array(x) for x in scored(texts[a:b], sent.value)]
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*kept, *STATS.names])
        released()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *STATS.fields]))


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id").dropna().distinct()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Count both multinomials over all documents and fix the threshold.

    The threshold is the score that tells the labelled good documents best from the labelled
    bad ones that the fixed rules let pass (the highest share of good ones kept plus bad ones
    rejected), in the middle of the gap.  Without good or without bad ones every score passes.
    """
    ids = good_ids(labels)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marked = docs.select("doc_id", text).join(
        (F.broadcast(ids) if few else ids).withColumn("_good", F.lit(True)), "doc_id", "left"
    ).select(text, F.coalesce("_good", F.lit(False)).alias("_good"))
    counts = (
        marked.mapInArrow(lambda it: counted(it, text), "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toPandas()
    )
    raw, good = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    raw[counts["bucket"]], good[counts["bucket"]] = counts["raw"], counts["good"]
    if not good.any():
        return Model(np.zeros(1 << BUCKET_BITS), -np.inf)
    ratios = np.log((good + SMOOTH) / (good + SMOOTH).sum()) - np.log((raw + SMOOTH) / (raw + SMOOTH).sum())

    rated = labels.where("quality IN (0, 1)").dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    few = rated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    pairs = docs.select("doc_id", text).join(F.broadcast(rated) if few else rated, "doc_id").select(text, "_quality")
    steps = (
        with_stats(pairs, ratios, text)
        .where(~F.col("base_failed"))
        .groupBy(F.floor(F.col("score") / STEP).alias("step"))
        .agg(F.sum("_quality").alias("good"), F.sum(1 - F.col("_quality")).alias("bad"))
        .toPandas()
        .sort_values("step")
    )
    return Model(ratios, best_threshold(steps))


def best_threshold(steps: pd.DataFrame) -> float:
    good, bad = steps["good"].to_numpy(float), steps["bad"].to_numpy(float)
    if good.sum() == 0 or bad.sum() == 0:
        return -np.inf
    # Keeping from step i on keeps the good of i and above and rejects the bad below i.
    kept = good[::-1].cumsum()[::-1] / good.sum()
    rejected = (bad.cumsum() - bad) / bad.sum()
    gain = np.append(kept + rejected, 1.0)
    best = int(np.argmax(gain))
    edges = steps["step"].to_numpy(float) * STEP
    if best == 0:
        return -np.inf
    if best == len(edges):
        return float(edges[-1] + STEP)
    return float((edges[best - 1] + STEP + edges[best]) / 2)


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the statistics, ``score`` and ``kept``.

    A null text has no words and fails the fixed rules, as an empty one.  Rows that repeat are
    judged each; columns named like the added ones are replaced; no rows give no rows.
    """
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold))
    return with_stats(docs, model.ratios, text).withColumn("kept", kept)
