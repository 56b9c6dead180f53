"""Near duplicates by SimHash, found through an inverted index over byte positions.

A fingerprint has eight bytes.  Two fingerprints that differ in at most three bits share at least
five bytes in their places, and so at least three of the first six.  The index therefore lists
fingerprints under every three of the first six bytes (position and value): a list of one byte
would hold every 256th fingerprint, a list of three every 2^24th.

1. Each pair of a posting list is tallied: how many bytes do the two share in place?
2. Pairs that reach the guaranteed five are kept, the others dropped.
3. What is kept is verified by counting the bits that differ.

Lists that near copies have made long are dealt anew under two more shared bytes, which again
every linked pair has.  There at most 2^24 fingerprints can stand together, and where many do,
the neighbours of a fingerprint are looked up instead of compared.  A task hands on which
fingerprints it found connected, not their pairs, so its output never exceeds its input.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .nearjoin import components

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits, or fewer.
BITS = 3
BYTES = 8
#: Bytes that linked fingerprints share at least: each differing bit spoils one.
SHARED = BYTES - BITS
#: Bytes of a posting key; of any ``KEY + BITS`` positions a linked pair shares so many.
KEY = 3
#: Fingerprints of a posting list that are compared with each other.
LIST = 4096
#: Lists up to this length are compared together, shifted against themselves.
SHORT = 16
STRIP = 256
#: Bytes of a text that are split at once, and shingles whose bits are counted at once.
SLICE = 1 << 20
HASHES = 1 << 15
#: Listed keys that may be broadcast (8 bytes each).
BROADCAST_KEYS = 250_000

_GAP = re.compile(rb"[\x20\x09-\x0d]")
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a lower-cased text, slice by slice."""
    digest = xxhash.xxh64_intdigest
    last: list[bytes] = []
    start, any_hash = 0, False
    while start < len(text):
        end = start + SLICE
        gap = _GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        words = last + text[start:end].lower().split()
        start = end
        for i in range(0, len(words) - SHINGLE + 1, HASHES):
            some = words[i : i + HASHES + SHINGLE - 1]
            whole = memoryview(b" ".join(some))
            ends = list(itertools.accumulate(len(w) + 1 for w in some))
            starts = [0, *ends[: len(some) - SHINGLE]]
            yield np.array([digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)], dtype=np.uint64)
            any_hash = True
        last = words[-(SHINGLE - 1) :]
    if last and not any_hash:
        yield np.array([digest(b" ".join(last), SEED)], dtype=np.uint64)


def simhash(text: bytes) -> int:
    """The fingerprint as a signed number; a text without words has 0."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprinted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``fp`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """In how many places the bytes are equal, given the exclusive or of two fingerprints."""
    return BYTES - np.bitwise_count((((x & _LOW) + _LOW) | x) & _HIGH)


def linked(x: np.ndarray) -> np.ndarray:
    """Tally, filter by the guaranteed count, verify: which exclusive ors belong to linked pairs."""
    found = shared_bytes(x) >= SHARED
    found[found] = np.bitwise_count(x[found]) <= BITS
    return found


def compared(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint of a list the first one that it is connected with in this list."""
    n = len(fps)
    near = np.empty((n, n), dtype=bool)
    for i in range(0, n, STRIP):
        near[i : i + STRIP] = linked(fps[i : i + STRIP, None] ^ fps[None, :])
    first = np.arange(n)
    while True:
        before = first.copy()
        for i in range(0, n, STRIP):
            first[i : i + STRIP] = np.where(near[i : i + STRIP], first[None, :], n).min(axis=1)
        first = first[first]
        if np.array_equal(first, before):
            return first


def looked_up(fps: np.ndarray) -> np.ndarray:
    """As :func:`compared`, for fingerprints that share five bytes: neighbours are looked up."""
    octets = fps.view(np.uint8).reshape(-1, BYTES)
    apart = np.flatnonzero((octets != octets[0]).any(axis=0))
    low = np.zeros(len(fps), dtype=np.int64)
    for k, byte in enumerate(apart):
        low |= octets[:, byte].astype(np.int64) << (8 * k)
    width = 8 * len(apart)
    place = np.full(1 << width, -1, dtype=np.int32)
    place[low] = np.arange(len(fps))
    masks = [sum(1 << b for b in bits) for k in range(1, BITS + 1) for bits in itertools.combinations(range(width), k)]
    first = np.arange(len(fps))
    while True:
        before = first.copy()
        for mask in masks:
            other = place[low ^ mask]
            there = other >= 0
            first[there] = np.minimum(first[there], first[other[there]])
        first = first[first]
        if np.array_equal(first, before):
            return first


def postings(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select("fp", F.explode(F.array(*keys)).alias("key"))


def byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(255)


def key_of(number: int, positions: tuple[int, ...]) -> Column:
    """Which positions, and the bytes there."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(byte(p))
    return key


def connected(posted: DataFrame) -> DataFrame:
    """``cid``, ``root`` for fingerprints that a posting list connects."""
    grouped = posted.select("key", "fp").repartition("key").sortWithinPartitions("key")

    def edges(keys: np.ndarray, fps: np.ndarray) -> list[np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        out = [np.zeros((0, 2), dtype=np.uint64)]
        short = np.repeat(sizes <= SHORT, sizes)
        for off in range(1, min(SHORT, int(sizes.max()))):
            i = np.flatnonzero((keys[off:] == keys[:-off]) & short[off:])
            i = i[linked(fps[i] ^ fps[i + off])]
            out.append(np.stack([fps[i + off], fps[i]], axis=1))
        for s, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            some = fps[s : s + n]
            first = compared(some) if n <= LIST else looked_up(some)
            more = first != np.arange(n)
            out.append(np.stack([some[more], some[first[more]]], axis=1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        kept: list[tuple] = []

        def told(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            both = np.concatenate(edges(keys, fps) if len(keys) else [np.zeros((0, 2), dtype=np.uint64)]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["cid", "root"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            kept.append((key, fp))
            if key[0] == key[-1] == kept[0][0][0]:
                continue  # still the same list
            keys, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield told(keys[:cut], fps[:cut])
            kept = [(keys[cut:], fps[cut:])]
        if kept:
            keys, fps = (np.concatenate(x) for x in zip(*kept, strict=True))
            yield told(keys, fps)

    return grouped.mapInArrow(run, "cid long, root long")


def links_of(prints: DataFrame) -> DataFrame:
    """``cid``, ``root`` edges that connect exactly the linked different fingerprints ``fp``."""
    heads = range(KEY + BITS)
    keys = list(itertools.combinations(heads, KEY))
    posted = stored(postings(prints, [key_of(i, p) for i, p in enumerate(keys)]))
    long = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIST).select("key"))
    long = small(long, BROADCAST_KEYS)
    found = connected(posted.join(long, "key", "left_anti"))
    # Of the five other bytes a linked pair shares two or more.
    rest = [tuple(b for b in range(BYTES) if b not in p) for p in keys]
    more = [list(itertools.combinations(r, SHARED - KEY)) for r in rest]
    again = posted.join(long, "key", "left_semi")
    wider = [
        F.array(*[F.struct(F.lit(j).alias("which"), key_of(0, q).alias("bytes")) for j, q in enumerate(m)]) for m in more
    ]
    number = F.shiftrightunsigned("key", 8 * KEY).cast("int")
    chosen = F.get(F.array(*wider), number)
    dealt = again.select("fp", "key", F.explode(chosen).alias("more")).select(
        # The first key has 29 bits, the further bytes 16, their choice 4.
        "fp", F.shiftleft("key", 20).bitwiseOR(F.shiftleft(F.col("more.which").cast("long"), 16)).bitwiseOR(F.col("more.bytes")).alias("key"),
    )
    return found.union(connected(dealt))


def near_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` for each row of ``docs``.

    Texts are lower-cased (A-Z only) and split at ASCII white space; their word shingles, repeats
    included, vote for the bits of ``fp``, and a bit is set if over half of them have it.  A text
    with fewer words is one shingle; one without words, null included, has the fingerprint 0 and
    links like any other.  Rows are linked if their fingerprints differ in at most :data:`BITS` bits;
    ``component_id`` is the least ``doc_id`` (nulls last) that links lead to, the own one included.
    Rows that repeat are linked rows; no rows give no rows; other columns are left out.
    """
    rows = stored(fingerprinted(docs, doc_id, text))
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links_of(prints.select("fp")))
    whole = prints.join(joined.withColumnRenamed("cid", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    whole = stored(whole)
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = whole.join(named, "component").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")
