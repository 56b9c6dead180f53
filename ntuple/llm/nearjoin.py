"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles.  In each of several runs, a node of the tree of
chosen paths holds the sets that reached it.  A set follows a shingle from a node to a child if
a hash of node and shingle falls below 1 / (threshold * size of the set), so two sets of the
wanted similarity are expected to share a child or more, and sets that share little part soon.  Nodes
with few sets are compared pair by pair; larger ones are split again, and after the last split
compared block by block.  Runs repeat until a pair at the threshold is missed less often than the
target allows.

What meets in a node is a parity sketch of each set, some twentieth of its shingles: bit i is the
parity of the number of shingles that fall on i.  Two sketches differ in no more bits than the sets
differ in shingles, so a pair that differs in too many is certainly no link; the others are
candidates.  Connected candidates are a group, whose members meet with all their shingles once,
however many nodes they shared; large groups meet block by block.  Every pair of a group is
compared exactly there, so links are counted without listing pairs.  Equal sets are one class from
the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, slices, small, stored

WORDS = 5
THRESHOLD = 0.8
#: Pairs at the threshold are missed at most this often.
MISS = 1e-5
#: Chance that a run misses a pair at the threshold where nodes are split once: it may share no child.
RUN_MISS = 0.42
#: Sets whose sketches one task compares with each other.
LEAF = 2048
#: Sets and shingles of a block of a group; one task compares two blocks.
BLOCK_SETS, BLOCK_TOKENS = 1024, 2_000_000
#: Sets of a node whose sketches are compared as numbers, one by one.
FEW = 24
DEPTH = 4
SLICE = 1_000_000
#: Columns of a dense block of the overlap matrix.
BLOCK = 1024
#: Rows of a strip of the overlap matrix.
STRIP = 256
#: Rows of looked-up tables that may be broadcast (at most some 400 bytes each).
BROADCAST_ROWS = 250_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def runs_for(miss: float = MISS, depth: int = 1) -> int:
    """Runs that miss a pair at the threshold at most so often if its nodes are split ``depth`` times.

    A pair is expected to share one child or more of a node.  It is missed below a node if every
    child that it shares (a Poisson number) misses it.
    """
    q = 0.0
    for _ in range(depth):
        q = math.exp(q - 1)
    return math.ceil(math.log(miss) / math.log(max(q, RUN_MISS)))


def roots_of(first: int, last: int) -> np.ndarray:
    """The roots of runs ``first`` + 1 to ``last``."""
    return mixed(np.arange(first + 1, last + 1, dtype=np.uint64) * GOLDEN)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each text, and their texts.

    A text with fewer words than a shingle has one of all its words.
    """
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    codes, unique = pd.factorize(np.fromiter((w for ws in split for w in ws), dtype=object, count=int(counts.sum())))
    if len(codes) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mixed(pd.util.hash_array(unique, categorize=False))[codes]
    doc = np.repeat(np.arange(len(texts)), counts)
    n = max(len(h) - WORDS + 1, 0)
    with np.errstate(over="ignore"):
        s = np.full(n, np.uint64(WORDS))
        for k in range(WORDS):
            s = mixed(s * GOLDEN + h[k : n + k])
    whole = doc[:n] == doc[WORDS - 1 :]
    s, d = s[whole], doc[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    begins = np.cumsum(counts) - counts
    more = []
    for i in short:
        x = np.array([counts[i]], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(begins[i], begins[i] + counts[i]):
                x = mixed(x * GOLDEN + h[k : k + 1])
        more.append(x[0])
    s, d = np.append(s, np.array(more, dtype=np.uint64)), np.append(d, short)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    return s[new], d[new]


def children(tokens: np.ndarray, limits: np.ndarray, node: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens a set follows from ``node``, and the children they lead to."""
    with np.errstate(over="ignore"):
        z = mixed(tokens.astype(np.uint64) * GOLDEN ^ node)
        followed = np.flatnonzero(z < limits)
        return followed, mixed(z[followed] + node).view(np.int64)


def limits_of(n: np.ndarray) -> np.ndarray:
    return ((2.0**64 - 2048) / np.maximum(THRESHOLD * n, 1.0)).astype(np.uint64)


def parity_sketches(tokens: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[bytes]:
    """A sketch for each set of ``n`` tokens: parities on as many bits as tokens, up to a power of two."""
    bits = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    ends = np.cumsum(bits)
    place = (ends - bits)[owner] + (tokens & (bits[owner] - 1).astype(np.uint32))
    parity = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    raw = np.packbits(parity, bitorder="little").tobytes()
    return [raw[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def sketched(docs: DataFrame, text: str, runs: int) -> DataFrame:
    """``n``, ``s1`` and ``s2`` (which set it is), ``keys`` (nodes after the first split), ``sketch`` and ``tokens``."""
    rest = [c for c in docs.columns if c != text]
    roots = roots_of(0, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            others = [c for i, c in enumerate(batch.columns) if i != at]
            for a, b in slices(texts, SLICE):
                s, d = shingles(texts[a:b])
                n = np.bincount(d, minlength=b - a)
                marks = [np.zeros(b - a, dtype=np.uint64), np.zeros(b - a, dtype=np.uint64)]
                with np.errstate(over="ignore"):
                    np.add.at(marks[0], d, mixed(s + GOLDEN))
                    np.add.at(marks[1], d, mixed(s ^ GOLDEN))
                tokens = (s >> np.uint64(32)).astype(np.uint32)
                limits = limits_of(n)[d]
                found = [(d[f], k) for f, k in (children(tokens, limits, r) for r in roots)]
                owner, key = np.concatenate([x for x, _ in found]), np.concatenate([k for _, k in found])
                order = np.argsort(owner, kind="stable")
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=b - a)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[order]))
                raw, ends = tokens.tobytes(), np.cumsum(n) * 4
                blobs = [raw[e - 4 * m : e] for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                sketch = pa.array(parity_sketches(tokens, d, n), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in others), pa.array(n), *(pa.array(m.view(np.int64)) for m in marks), keys, sketch, pa.array(blobs, pa.binary())],
                    names=[*rest, "n", "s1", "s2", "keys", "sketch", "tokens"],
                )
        released()

    zero = F.lit(0).cast("long")
    schema = docs.select(
        *rest, zero.alias("n"), zero.alias("s1"), zero.alias("s2"), F.array().cast("array<bigint>").alias("keys"),
        F.lit(b"").alias("sketch"), F.lit(b"").alias("tokens"),
    ).schema
    return docs.select(*rest, text).mapInArrow(run, schema)


def parted(rows: DataFrame) -> DataFrame:
    """One more split of ``nodes`` (too large ones) for sets ``cid``, ``n``, ``tokens``: ``cid``, ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, keys = [], []
            for cid, n, blob, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens, limits = np.frombuffer(blob, dtype=np.uint32), limits_of(np.array([n]))
                for node in nodes:
                    found = children(tokens, limits, np.int64(node).view(np.uint64))[1]
                    cids.append(np.full(len(found), cid, dtype=np.int64))
                    keys.append(found)
            none = [np.zeros(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (cids, keys)], names=["cid", "key"])
        released()

    return rows.select("cid", "n", "tokens", "nodes").mapInArrow(run, "cid long, key long")


def leaves_of(first: DataFrame, sets: DataFrame, classes: DataFrame, miss: float) -> DataFrame:
    """``cid``, ``key``, ``size`` for each set and leaf; of leaves with the same sets, one.

    A pair is missed more often the more often its nodes are split, so the sets of nodes that
    were split take part in further runs, as many as the deepest split calls for.
    """
    reached, leaves, split = first, [], None
    runs, deepest = runs_for(miss), 1

    def parted_below(members: DataFrame) -> DataFrame:
        members = members.join(classes.select("cid", "_file", "_row"), "cid")
        held = sets.select("_file", "_row", "n", "tokens").join(small(members, BROADCAST_ROWS), ["_file", "_row"])
        return stored(parted(held))

    while True:
        for depth in range(1, DEPTH + 1):
            deepest = max(deepest, depth)
            # Most nodes hold one set and end here.
            sizes = stored(reached.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
            most = F.col("size") <= LEAF if depth < DEPTH else F.lit(True)
            leaves.append(reached.join(sizes.where(most), "key").select("cid", "key", "size"))
            large = sizes.where(~most).select("key")
            if not large.limit(1).count():
                break
            members = reached.join(large, "key").groupBy("cid").agg(F.collect_list("key").alias("nodes"))
            if split is None:
                split = members = stored(members)
            reached = parted_below(members)
        more = runs_for(miss, deepest)
        # A set that no run has split so far meets its partners in nodes that were split once.
        if split is None or more <= runs:
            break
        roots = F.array(*[F.lit(int(r)) for r in roots_of(runs, more).view(np.int64)])
        reached, runs = parted_below(split.select("cid", roots.alias("nodes"))), more
    leaves = stored(reduce(DataFrame.unionByName, leaves))
    mark = F.xxhash64("cid")
    marked = leaves.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("m1"), F.sum(F.pmod(mark, F.lit((1 << 31) - 1))).alias("m2")
    )
    one = marked.groupBy("size", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    return leaves.join(one, "key", "left_semi").select("cid", "key", "size")


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a key into its ``blocks``; a row comes once for each pair of blocks with its own.

    Adds ``bi`` <= ``bj`` (the pair) and ``side``; rows of one pair come together, in order.
    """
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.withColumns(
        {"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}
    ).drop("own", "other")
    return pairs.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def folded(sketch: int, bits: int, to: int) -> int:
    """The sketch of the same set on fewer bits."""
    while bits > to:
        bits >>= 1
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def least_labels(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The least label of everyone's connected part of a symmetric matrix."""
    none = np.iinfo(np.int64).max
    labels = labels.copy()
    while True:
        before = labels.copy()
        for i in range(0, len(labels), STRIP):
            k = slice(i, i + STRIP)
            labels[k] = np.minimum(labels[k], np.where(near[k], labels[None, :], none).min(axis=1))
        if np.array_equal(before, labels):
            return labels


def signs(sketches: list[bytes], to: int) -> np.ndarray:
    """Rows of sketches of one length as packed bytes of ``to`` bytes each."""
    packed = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), -1)
    while packed.shape[1] > to:
        half = packed.shape[1] // 2
        packed = packed[:, :half] ^ packed[:, half:]
    return packed


def candidates(rows: list[tuple], cross: bool) -> list[tuple[int, int]]:
    """``(cid, root)`` for the sets of a node that may have a link in it: connected ones share a root.

    ``rows``: ``(cid, n, sketch, side)``; with ``cross`` only sets of different sides meet.  A pair may
    be linked if the lesser set is at least 4 / 5 of the other and the sketches differ in no
    more than (na + nb) / 9 bits, as many shingles as linked sets differ in at most.
    """
    rows = sorted(rows, key=lambda r: r[1])
    if len(rows) <= FEW:
        roots = {r[0]: r[0] for r in rows}

        def root(x: int) -> int:
            while roots[x] != x:
                x = roots[x]
            return x

        numbers = [int.from_bytes(r[2], "little") for r in rows]
        for i, (x, na, sa, side) in enumerate(rows):
            for j in range(i + 1, len(rows)):
                y, nb, sb, other = rows[j]
                if 5 * na < 4 * nb:
                    break
                if cross and side == other:
                    continue
                differ = numbers[i] ^ folded(numbers[j], 8 * len(sb), 8 * len(sa))
                if 9 * differ.bit_count() <= na + nb:
                    a, b = root(x), root(y)
                    roots[max(a, b)] = min(a, b)
        return [(x, root(x)) for x in roots if root(x) != x]
    cids, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    sides, length = np.array([r[3] for r in rows]), np.array([len(r[2]) for r in rows])
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for wide in np.unique(length):
        mine = np.flatnonzero(length == wide)
        for theirs in (mine, np.flatnonzero(length == 2 * wide)):
            if len(theirs) == 0:
                continue
            a, b = (signs([rows[i][2] for i in side], int(wide)) for side in (mine, theirs))
            same = np.zeros((len(mine), len(theirs)), dtype=np.float32)
            for k in range(0, int(wide), BLOCK // 8):
                x, y = (2 * np.unpackbits(m[:, k : k + BLOCK // 8], axis=1).astype(np.float32) - 1 for m in (a, b))
                same += x @ y.T
            for i in range(0, len(mine), STRIP):
                of = mine[i : i + STRIP]
                na, nb = n[of][:, None], n[theirs][None, :]
                close = 9 * (8 * wide - same[i : i + STRIP]) <= 2 * (na + nb)
                close &= 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)
                if cross:
                    close &= sides[of][:, None] != sides[theirs][None, :]
                near[np.ix_(of, theirs)] |= close
    near |= near.T
    roots = least_labels(near, cids)
    moved = np.flatnonzero(roots != cids)
    return list(zip(cids[moved].tolist(), roots[moved].tolist(), strict=True))


def met(rows: DataFrame) -> DataFrame:
    """``cid``, ``root`` of the candidates of each node or pair of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        out: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["cid", "root"])
            out.clear()
            return done

        for batch in batches:
            for key, bi, bj, side, cid, n, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, bi, bj) != current:
                    if len(group) > 1:
                        out += candidates(group, current[1] != current[2])
                    current, group = (key, bi, bj), []
                group.append((cid, n, sketch, side))
            yield batch_of()
        if len(group) > 1:
            out += candidates(group, current[1] != current[2])
        yield batch_of()
        released()

    columns = ["key", "bi", "bj", "side", "cid", "n", "sketch"]
    return rows.select(*columns).mapInArrow(run, "cid long, root long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``a`` shares with each set of ``b``."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.float32)
    sizes = np.array([len(x) for x in a + b])
    _, column, times = np.unique(np.concatenate(a + b), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a) + len(b)), sizes)
    # A token of one set alone overlaps with nothing.
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(often.sum())
    for start in range(0, width, BLOCK):
        lo, hi = np.searchsorted(column, (start, start + BLOCK))
        dense = np.zeros((len(a) + len(b), min(BLOCK, width - start)), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - start] = 1
        total += dense[: len(a)] @ dense[len(a) :].T
    return total


def compared(rows: list[tuple], cross: bool) -> list[tuple[int, int, int]]:
    """``(cid, root, links)`` for the sets of a group or two of its blocks that have a partner there.

    ``rows``: ``(cid, n, mult, tokens, side)``; with ``cross`` only sets of different sides meet.
    """
    left = [r for r in rows if r[4] == 0] if cross else rows
    right = [r for r in rows if r[4] == 1] if cross else rows
    if not left or not right:
        return []
    shared = overlaps([r[3] for r in left], [r[3] for r in right])
    na, nb = (np.array([r[1] for r in side], dtype=np.float64) for side in (left, right))
    strips = [slice(i, i + STRIP) for i in range(0, len(left), STRIP)]
    near = np.zeros(shared.shape, dtype=bool)
    for k in strips:
        # shared / (na + nb - shared) >= 4 / 5 in whole numbers, so that the border is exact.
        near[k] = 9.0 * shared[k] >= 4.0 * (na[k, None] + nb[None, :])
    del shared
    if not cross:
        np.fill_diagonal(near, False)
    if not near.any():
        return []
    mult_a, mult_b = (np.array([r[2] for r in side], dtype=np.float64) for side in (left, right))
    links_a = np.concatenate([near[k] @ mult_b for k in strips])
    links_b = sum(mult_a[k] @ near[k] for k in strips)
    # Everyone takes the least label next to it until nothing changes.
    roots_a, roots_b = (np.array([r[0] for r in side], dtype=np.int64) for side in (left, right))
    none = np.iinfo(np.int64).max
    while True:
        before = roots_a.copy(), roots_b.copy()
        for k in strips:
            roots_a[k] = np.minimum(roots_a[k], np.where(near[k], roots_b[None, :], none).min(axis=1))
        for k in strips:
            roots_b = np.minimum(roots_b, np.where(near[k], roots_a[k, None], none).min(axis=0))
        if not cross:
            roots_a = roots_b = np.minimum(roots_a, roots_b)
        if np.array_equal(before[0], roots_a) and np.array_equal(before[1], roots_b):
            break
    out = [(r[0], int(x), int(round(n))) for r, x, n in zip(left, roots_a, links_a, strict=True)]
    if cross:
        out += [(r[0], int(x), int(round(n))) for r, x, n in zip(right, roots_b, links_b, strict=True)]
    return [x for x in out if x[2] or x[1] != x[0]]


def linked(rows: DataFrame) -> DataFrame:
    """Compare the sets of each group or pair of its blocks: ``cid``, ``root``, ``links``, ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            if len(group) > 1:
                _, bi, bj, blocks = current
                out.extend((*found, blocks) for found in compared(group, bi != bj))

        def batch_of() -> pa.RecordBatch:
            names = ["cid", "root", "links", "blocks"]
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=names)
            out.clear()
            return done

        for batch in batches:
            for key, bi, bj, blocks, side, cid, n, mult, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, bi, bj, blocks) != current:
                    close()
                    current, group = (key, bi, bj, blocks), []
                group.append((cid, n, mult, np.frombuffer(blob, dtype=np.uint32), side))
            yield batch_of()
        close()
        yield batch_of()
        group.clear()
        released()

    columns = ["component", "bi", "bj", "blocks", "side", "cid", "n", "mult", "tokens"]
    return rows.select(*columns).mapInArrow(run, "cid long, root long, links long, blocks long")


def components(edges: DataFrame) -> DataFrame:
    """``cid``, ``component`` (its least ``cid``) for the connected sets of ``cid``, ``root`` edges.

    Every set takes the least label among its neighbours and then the label of that label,
    until nothing changes; each round is a written table.
    """
    both = stored(edges.select("cid", "root").union(edges.select("root", "cid")).distinct())
    labels = stored(both.groupBy("cid").agg(F.least(F.min("root"), F.col("cid")).alias("label")))
    while True:
        offered = both.join(labels.select(F.col("cid").alias("root"), F.col("label").alias("other")), "root").groupBy("cid").agg(F.min("other").alias("other"))
        lower = labels.join(offered, "cid").select("cid", F.least("label", "other").alias("label"), F.col("label").alias("was"))
        jump = lower.select(F.col("cid").alias("label"), F.col("label").alias("further"))
        lower = stored(lower.join(jump, "label").select("cid", F.least("label", "further").alias("label"), "was"))
        if not lower.where("label < was").limit(1).count():
            return lower.select("cid", F.col("label").alias("component"))
        labels = lower.drop("was")


def near_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """``_file``, ``_row``, ``doc_id``, ``class_id``, ``n_links`` and ``first`` for each row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least
    :data:`THRESHOLD`; ``n_links`` counts the other rows that a row is linked with, copies
    included.  Classes are connected documents; ``class_id`` is the least ``doc_id`` (null last) of the
    class and ``first`` marks the row that has it.  Overlaps are counted on 32 bits of a shingle's
    hash.  Texts without words (null included) are equal to each other.  Rows that
    repeat are copies; no rows give no rows.  ``docs`` has ``_file`` and ``_row``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), "_file", "_row", F.col(text).alias("text"))
    sets = stored(sketched(rows, "text", runs_for(miss)))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")
    which = ["n", "s1", "s2"]
    classes = stored(
        sets.groupBy(*which)
        .agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        .withColumn("cid", F.monotonically_increasing_id())
        .withColumns({"_file": F.col("rep._file"), "_row": F.col("rep._row")})
    )
    first = classes.where("n > 0").select("cid", F.explode("keys").alias("key"))
    leaves = leaves_of(first, sets, classes, miss).join(classes.select("cid", "n", "sketch"), "cid")
    nodes = in_blocks(leaves.withColumn("blocks", F.ceil(F.col("size") / LEAF).cast("int")), "key")
    groups = components(met(nodes))
    weights = groups.join(classes.select("cid", "n", "mult", "_file", "_row"), "cid")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int")
    wanted = weights.drop("n").join(weights.groupBy("component").agg(blocks.alias("blocks")), "component")
    held = sets.select("_file", "_row", "n", "tokens").join(small(stored(wanted), BROADCAST_ROWS), ["_file", "_row"])
    found = stored(linked(in_blocks(held, "component")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    moved = found.where("cid <> root")
    joined = (
        moved.where("blocks = 1").select("cid", F.col("root").alias("component"))
        .union(components(moved.where("blocks > 1").select("cid", "root")))
    )
    whole = classes.select("cid", "mult", "rep", *which).join(links, "cid", "left").join(joined, "cid", "left")
    whole = stored(whole.withColumn("component", F.coalesce("component", "cid")))
    named = whole.groupBy("component").agg(F.min("rep").alias("head"))
    classed = whole.join(named, "component").select(*which, "head", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets.select("doc_id", "_file", "_row", *which).join(classed, which).select(
        "_file", "_row", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links",
        ((F.col("_file") == F.col("head._file")) & (F.col("_row") == F.col("head._row"))).alias("first"),
    )
