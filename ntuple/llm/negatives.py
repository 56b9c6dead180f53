"""Hard negatives by the threshold algorithm.

Vectors become whole numbers and are dealt into blocks.  For a block a task keeps one list of its
rows for each dimension, sorted by that component.  An anchor walks all lists at once (sorted
access): from the top where its own component is positive, from the bottom where it is negative.
Rows met for the first time are scored with their whole vectors (random access).  No row that
has not been met can score more than the anchor with the components at which the lists stand;
once this threshold falls strictly below the last score that a window can still take, the walk
ends.  What the blocks found is merged by rank.

A first walk finds the positives of each anchor, a second one the negatives in the windows that
the positives open.  Anchors are dealt into blocks as well, so a task sees a bounded block of either
and no row is compared twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows or anchors of a block, about.
BLOCK = 16_384
#: Blocks of rows, at least: so many tasks share the work of a small table.
SPREAD = 24
#: Rows of every list that the first step of a walk takes; each step takes as many as all before.
FIRST_STEP = 16
#: Sums of products below this are exact in floating point.
EXACT = 2.0**53


@dataclass
class Best:
    """The ``k`` best rows in a window of scores, higher scores first, then smaller ids."""

    k: int
    low: float | None = None
    high: float | None = None
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def take(self, scores: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            scores, rows = scores[inside], rows[inside]
        if len(self.rows) == self.k:
            good = scores >= self.scores[-1]
            scores, rows = scores[good], rows[good]
        if not len(rows):
            return
        if len(self.rows):
            scores, rows = np.concatenate([self.scores, scores]), np.concatenate([self.rows, rows])
        first = np.lexsort((ids[rows], -scores))[: self.k]
        self.scores, self.rows = scores[first], rows[first]

    def closed(self, threshold: float) -> bool:
        """No row that was not met can come in; rows that tie with the last one still could."""
        if self.low is not None and (threshold < self.low or self.low > self.high):
            return True
        return len(self.rows) == self.k and threshold < self.scores[-1]


def walk(lists: np.ndarray, vectors: np.ndarray, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Rows met for the first time, their scores, and the threshold after each step.

    ``lists``: dimensions by rows, ascending by the component of the dimension.
    """
    n = len(vectors)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    dims = np.concatenate([up, down])
    met = np.zeros(n, dtype=bool)
    done, step = 0, FIRST_STEP
    while done < n:
        # An anchor without components scores 0 with every row; there is nothing to walk.
        upto = min(n, done + step) if len(dims) else n
        seen = np.zeros(n, dtype=bool)
        if len(dims):
            seen[lists[up, n - upto : n - done]] = True
            seen[lists[down, done:upto]] = True
        else:
            seen[:] = True
        new = np.flatnonzero(seen & ~met)
        met |= seen
        left = upto < n and not met.all()
        at = np.concatenate([lists[up, n - upto], lists[down, upto - 1]])
        threshold = (vectors[at, dims] * anchor[dims]).sum() if left else -np.inf
        scores = vectors[new] @ anchor
        yield new, scores.astype(np.int64) if vectors.dtype == object else scores, threshold
        if not left:
            return
        done, step = upto, upto


def whole_numbers(tables: list[pa.Table], scale: int) -> list[np.ndarray]:
    """The scaled, rounded down vectors of each table; shorter vectors are filled up with zeros.

    Floating point holds them if no sum of products can leave its whole numbers, else Python's own.
    """
    arrays = [t.column("vector").combine_chunks() for t in tables]
    sizes = [pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64) for a in arrays]
    dims = max([1, *(int(s.max()) for s in sizes if len(s))])
    raw = []
    for a, s in zip(arrays, sizes, strict=True):
        out = np.zeros((len(s), dims))
        flat = a.flatten().to_numpy(zero_copy_only=False)
        out[np.repeat(np.arange(len(s)), s), np.arange(len(flat)) - np.repeat(np.cumsum(s) - s, s)] = flat
        raw.append(out)
    largest = 1.0
    for r in raw:
        largest *= scale * max(1.0, float(np.abs(r).max(initial=0.0))) + 1
    if largest * dims < EXACT:
        return [np.floor(scale * r) for r in raw]
    exact = np.vectorize(lambda v: int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)), otypes=[object])
    return [exact(r) for r in raw]


_CELL = ["rb", "ab"]
_POSITIVES = "a_row long, a_id long, label long, p_row long, p_id long, score long"
_NEGATIVES = "a_row long, a_id long, no int, p_id long, p_score long, n_row long, n_id long, score long"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(names, columns, strict=True)})


def _block(rows: pa.Table, anchors: pa.Table, scale: int) -> tuple:
    vectors, wanted = whole_numbers([rows, anchors], scale)
    lists = np.argsort(vectors, axis=0, kind="stable").T
    named = [[t.column(c).to_numpy() for c in ("row", "id", "label")] for t in (rows, anchors)]
    return vectors, lists, *named, wanted


def positives_in(rows: pa.Table, anchors: pa.Table, k: int, scale: int) -> pa.Table:
    """The best ``k`` other rows of the anchor's label in a block, for each anchor."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        vectors, lists, (row, ids, label), (a_row, a_id, a_label), wanted = _block(rows, anchors, scale)
        for i, anchor in enumerate(wanted):
            best = Best(k)
            for new, scores, threshold in walk(lists, vectors, anchor):
                same = (label[new] == a_label[i]) & (row[new] != a_row[i])
                best.take(scores[same], new[same], ids)
                if best.closed(threshold):
                    break
            out += [(a_row[i], a_id[i], a_label[i], row[x], ids[x], int(s)) for x, s in zip(best.rows, best.scores, strict=True)]
    return _table(out, _POSITIVES)


def negatives_in(rows: pa.Table, anchors: pa.Table, k: int, low: int, high: int, scale: int) -> pa.Table:
    """The best ``k`` rows of another label in a block, for each window of each anchor."""
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        vectors, lists, (row, ids, label), (a_row, a_id, a_label), wanted = _block(rows, anchors, scale)
        for i, (anchor, windows) in enumerate(zip(wanted, anchors.column("windows").to_pylist(), strict=True)):
            # low * positive <= 100 * score <= high * positive, as bounds in whole numbers.
            open_ = [(w, Best(k, -(-low * w["score"] // 100), high * w["score"] // 100)) for w in windows]
            every = list(open_)
            for new, scores, threshold in walk(lists, vectors, anchor):
                other = label[new] != a_label[i]
                for _, best in open_:
                    best.take(scores[other], new[other], ids)
                open_ = [(w, best) for w, best in open_ if not best.closed(threshold)]
                if not open_:
                    break
            for w, best in every:
                out += [(a_row[i], a_id[i], w["no"], w["p_id"], w["score"], row[x], ids[x], int(s)) for x, s in zip(best.rows, best.scores, strict=True)]
    return _table(out, _NEGATIVES)


def hard_negatives(
    df: DataFrame,
    *,
    id: str,
    vector: str,
    label: Column,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component ``x`` counts as ``floor(scale * x)``; a score is the inner product with the anchor.  For each
    anchor and each of its best ``positives`` other rows of its label, the best ``negatives`` rows of other
    labels that score from ``low`` to ``high`` hundredths of the positive.  Ties go to the smaller id.
    Rows without id, label or vector, or with a component that is null or not finite, take no part;
    shorter vectors are filled up with zeros; rows that repeat are rows of their own, also as anchors.
    An anchor without positives or negatives gives no rows.  Scores must fit 64 bits, else it raises.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    given = df.select(
        F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.coalesce(finite, F.lit(False)).alias("finite"),
    )
    whole = given.where(F.col("finite") & F.col("id").isNotNull() & F.col("label").isNotNull()).drop("finite")
    rows = stored(whole.withColumn("row", F.monotonically_increasing_id()))
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    row_blocks, anchor_blocks = max(SPREAD, -(-n // BLOCK)), max(1, -(-n_anchors // BLOCK))

    def dealt(some: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        cells = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return some.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(other, cells)

    plain = dealt(rows.drop("anchor"), "rb", row_blocks, "ab", anchor_blocks)
    # New columns: a cogroup must tell the two sides of one table apart.
    asked = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("id", "label", "vector", "row")])
    near = plain.groupBy(*_CELL).cogroup(dealt(asked, "ab", anchor_blocks, "rb", row_blocks).groupBy(*_CELL))
    found = near.applyInArrow(lambda a, b: positives_in(a, b, positives, scale), _POSITIVES)
    order = [F.desc("score"), "p_id", "p_row"]
    ranked = found.withColumn("no", F.row_number().over(Window.partitionBy("a_row").orderBy(*order))).where(F.col("no") <= positives)
    windows = ranked.groupBy("a_row").agg(F.collect_list(F.struct("no", "p_id", "score")).alias("windows"))
    opened = stored(asked.join(windows.withColumnRenamed("a_row", "row"), "row"))
    far = plain.groupBy(*_CELL).cogroup(dealt(opened, "ab", anchor_blocks, "rb", row_blocks).groupBy(*_CELL))
    missed = far.applyInArrow(lambda a, b: negatives_in(a, b, negatives, low, high, scale), _NEGATIVES)
    order = [F.desc("score"), "n_id", "n_row"]
    rank = F.row_number().over(Window.partitionBy("a_row", "no").orderBy(*order))
    return missed.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank",
        F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
