"""Audit of how the sources of a language differ, on a quadtree over the group-term counts.

For each language the counts form a matrix: a row for each source, a column for each kept term.
Most of its cells are zero.  The matrix is cut into cells of some sources and some terms; a task
builds the quadtree of a cell (a node is split into two by two quadrants, an all-zero quadrant
ends there) and walks it jointly for all pairs of sources: where both quadrants of a pair are
zero, every term has the same two probabilities, so their divergence is priced at once by the
number of terms; only leaves in which one of the two is not zero are computed term by term.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

#: Terms are kept that so many documents of the language hold.
MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Sources and terms of a cell of the matrix, about.
ROWS = 128
COLUMNS = 2048
#: Sources and terms of a leaf.
LEAF_ROWS = 4
LEAF_COLUMNS = 32
#: Numbers of a batch of leaves.
BATCH = 1 << 20
#: Terms that a task remembers before it hands on their counts.
REMEMBERED = 200_000
#: Bytes of a text that are split at once.
SLICE = 1 << 20
BROADCAST_ROWS = 100_000

#: Letters are lower-cased, all other ASCII characters are gaps; bytes of longer characters stay.
_FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a text."""
    folded, found, start = text.translate(_FOLD), Counter(), 0
    while start < len(folded):
        end = folded.find(b" ", start + SLICE)
        end = len(folded) if end < 0 else end
        found.update(folded[start:end].split())
        start = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``docs`` for rows ``lang``, ``source``, ``text`` (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[tuple, Counter] = {}
        holds: dict[tuple, Counter] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), counter in often.items():
                if not counter:
                    continue
                terms = pc.cast(pa.array(list(counter), pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
                n, d = pa.array(counter.values(), pa.int64()), pa.array(map(holds[lang, source].__getitem__, counter), pa.int64())
                both = [pa.array([x] * len(counter), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*both, terms, n, d], names=["lang", "source", "term", "n", "docs"])
            often.clear()
            holds.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms_of(text)
                counter = often.setdefault((lang, source), Counter())
                size -= len(counter)
                # Counter.update adds the counts of a mapping.
                counter.update(found)
                holds.setdefault((lang, source), Counter()).update(list(found))
                size += len(counter)
                if size > REMEMBERED:
                    yield from told()
                    size = 0
        yield from told()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def price(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / total)`` by long division, exact for totals below 9e15."""
    rest = count + 2
    out, rest = rest // total, rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def quadtree(filled: np.ndarray) -> list[np.ndarray]:
    """Which nodes of each level hold a nonzero count, from the leaves up to the root.

    ``filled``: a square of leaves whose side is a power of two.
    """
    levels = [filled]
    while len(levels[-1]) > 1:
        half = len(levels[-1]) // 2
        levels.append(levels[-1].reshape(half, 2, half, 2).any(axis=(1, 3)))
    return levels


def pair_sums(counts: np.ndarray, totals: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Divergences summed over the terms, for rows ``a < b`` of ``counts`` (sources by terms).

    With ``side``, only pairs of rows of different sides are wanted.  Rows are padded to leaves and
    the leaves to a square, whose padding is empty and costs nothing.
    """
    n, m = counts.shape
    depth = max((-(-n // LEAF_ROWS) - 1).bit_length(), (-(-m // LEAF_COLUMNS) - 1).bit_length(), 0)
    square = 1 << depth
    high, wide = -(-n // LEAF_ROWS), -(-m // LEAF_COLUMNS)
    # Columns with the same sources stand together, so that quadrants are empty or full.
    ordered = counts[:, np.lexsort(counts > 0)]
    # Padding has the same probability everywhere and adds nothing.
    p = np.ones((high * LEAF_ROWS, wide * LEAF_COLUMNS), dtype=np.int64)
    p[:n, :m] = price(ordered, totals[:, None])
    p = p.reshape(high, LEAF_ROWS, wide, LEAF_COLUMNS).swapaxes(1, 2)
    nonzero = np.zeros((high * LEAF_ROWS, wide * LEAF_COLUMNS), dtype=bool)
    nonzero[:n, :m] = ordered > 0
    filled = np.zeros((square, square), dtype=bool)
    filled[:high, :wide] = nonzero.reshape(high, LEAF_ROWS, wide, LEAF_COLUMNS).any(axis=(1, 3))
    levels = quadtree(filled)
    width = np.zeros(square, dtype=np.int64)
    width[:wide] = LEAF_COLUMNS
    width[wide - 1] -= wide * LEAF_COLUMNS - m
    sides = None
    if side is not None:
        sides = np.zeros((2, square), dtype=bool)
        for s in (0, 1):
            sides[s, np.flatnonzero(side == s) // LEAF_ROWS] = True
    real = np.arange(square) < high
    i = j = c = np.zeros(1, dtype=np.int64)
    zeros = np.zeros((n, n), dtype=np.int64)
    for level in range(depth, -1, -1):
        step = 1 << level
        node_width = width.reshape(-1, step).sum(axis=1)
        wanted = (i <= j) & real[i * step] & real[j * step] & (node_width[c] > 0)
        if sides is not None:
            has = sides.reshape(2, -1, step).any(axis=2)
            wanted &= (has[0, i] & has[1, j]) | (has[1, i] & has[0, j])
        i, j, c = i[wanted], j[wanted], c[wanted]
        some = levels[level][i, c] | levels[level][j, c]
        # Uniform quadrants: the number of their terms, for all pairs of their rows at once.
        empty = np.zeros((square // step, square // step), dtype=np.int64)
        np.add.at(empty, (i[~some], j[~some]), node_width[c[~some]])
        of_row = np.arange(n) // (LEAF_ROWS * step)
        zeros += empty[of_row[:, None], of_row[None, :]]
        i, j, c = i[some], j[some], c[some]
        if level:
            bits = np.arange(8)
            i, j, c = (np.add.outer(2 * x, (bits >> k) & 1).ravel() for k, x in enumerate((i, j, c)))
    sums = np.zeros((high, high, LEAF_ROWS, LEAF_ROWS), dtype=np.int64)
    step = max(1, BATCH // (LEAF_ROWS * LEAF_ROWS * LEAF_COLUMNS))
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        of_a, of_b = p[a, c[k : k + step]][:, :, None, :], p[b, c[k : k + step]][:, None, :, :]
        np.add.at(sums, (a, b), divergence(of_a, of_b).sum(axis=3))
    sums = sums.swapaxes(1, 2).reshape(high * LEAF_ROWS, high * LEAF_ROWS)[:n, :n]
    nothing = price(np.zeros(n, dtype=np.int64), totals)
    return sums + zeros * divergence(nothing[:, None], nothing[None, :])


_CELL = ["lang", "tb", "si", "sj"]
_FOUND = "lang string, source string, other string, term string, value long, columns long, n_a long, n_b long, v long"


def audit_cell(entries: pa.Table, groups: pa.Table, top: int = TOP) -> pa.Table:
    """Pairs of sources over the terms of a cell, and the best terms of each source in it."""
    out: dict[str, list] = {f.split()[0]: [] for f in _FOUND.split(", ")}
    # A pair has the same order in every cell.
    groups = groups.sort_by("source")
    names = groups.column("source").to_pylist()
    if names:
        lang, v = groups.column("lang")[0].as_py(), groups.column("v")[0].as_py()
        si, sj = groups.column("si")[0].as_py(), groups.column("sj")[0].as_py()
        n, block = groups.column("n_terms").to_numpy(), groups.column("sb").to_numpy()
        terms = sorted(set(x.as_buffer().to_pybytes() for x in entries.column("term").unique()))
        row, column = {s: k for k, s in enumerate(names)}, {t: k for k, t in enumerate(terms)}
        counts = np.zeros((len(names), len(terms)), dtype=np.int64)
        total = np.zeros(len(terms), dtype=np.int64)
        x = np.array([row[s] for s in entries.column("source").to_pylist()], dtype=np.int64)
        y = np.array([column[t.as_buffer().to_pybytes()] for t in entries.column("term")], dtype=np.int64)
        counts[x, y] = entries.column("n").to_numpy()
        total[y] = entries.column("total").to_numpy()
        sums = np.zeros((len(names), len(names)), dtype=np.int64)
        if terms:
            sums = pair_sums(counts, n + 2 * v, None if si == sj else (block == sj).astype(int))
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                if si == sj or block[a] != block[b]:
                    for key, value in zip(out, (lang, names[a], names[b], None, int(sums[a, b]), len(terms), int(n[a]), int(n[b]), v), strict=True):
                        out[key].append(value)
        if terms and si == sj:
            q = price(total, np.int64(groups.column("n_lang")[0].as_py() + 2 * v))
            for a in range(len(names)):
                here = np.flatnonzero(counts[a])
                p = price(counts[a, here], n[a] + 2 * v)
                here, p = here[p > q[here]], p[p > q[here]]
                f = divergence(p, q[here])
                for k in np.lexsort((here, -f))[:top]:
                    for key, value in zip(out, (lang, names[a], None, terms[here[k]], int(f[k]), None, None, None, None), strict=True):
                        out[key].append(value)
    out["term"] = pc.cast(pa.array(out["term"], pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
    kinds = [pa.string()] * 4 + [pa.int64()] * 5
    return pa.table({k: x if k == "term" else pa.array(x, t) for (k, x), t in zip(out.items(), kinds, strict=True)})


def _price_of_zero(n: str) -> Column:
    return F.expr(f"1 + {2 * SCALE} div ({n} + 2 * v)")


def audit(
    docs: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how sources differ.

    Part ``pair`` has the divergence from each other source of the language, over all kept terms;
    part ``term`` the ``top`` terms that a source has more often than its language.  Terms are runs
    of letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those in at
    least ``min_docs`` of its documents.  Null texts, languages and sources are empty ones.  Groups
    without terms are compared too; a language that keeps no term gives 0.  Ranks break ties by
    the item.  Repeated rows are documents of their own; no rows give no rows.
    """
    plain = [F.coalesce(F.col(c), F.lit("")) for c in (lang, source, text)]
    rows = docs.select(plain[0].alias("lang"), plain[1].alias("source"), plain[2].cast("binary").alias("text"))
    found = term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(found)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    entries = stored(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]))
    pairs = stored(rows.select("lang", "source").distinct())
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n_terms"))
    firsts = entries.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = firsts.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    many = pairs.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(whole, "lang", "left").na.fill(0, ["v", "n_lang"])
    cuts = many.select(
        "lang", "v", "n_lang",
        F.ceil(F.col("sources") / ROWS).cast("int").alias("nsb"), F.greatest(F.ceil(F.col("v") / COLUMNS), F.lit(1)).cast("int").alias("ntb"),
    )
    cuts = small(stored(cuts), BROADCAST_ROWS)
    sb = F.pmod(F.xxhash64("source"), F.col("nsb")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("nsb") - 1))
    groups = pairs.join(own, ["lang", "source"], "left").na.fill(0, ["n_terms"]).join(cuts, "lang").withColumn("sb", sb)
    ends = [F.least("sb", "other").alias("si"), F.greatest("sb", "other").alias("sj")]
    of_group = groups.withColumn("other", each).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("ntb") - 1))).select(
        "lang", "tb", *ends, "source", "sb", "n_terms", "n_lang", "v"
    )
    of_entry = entries.join(cuts, "lang").withColumn("sb", sb).withColumn("other", each).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("ntb")).cast("int").alias("tb"), *ends, "source", "term", "n", "total"
    )
    cells = of_entry.groupBy(*_CELL).cogroup(of_group.groupBy(*_CELL))
    priced = stored(cells.applyInArrow(lambda left, right: audit_cell(left, right, top), _FOUND))
    summed = (
        priced.where("other is not null")
        .groupBy("lang", "source", "other")
        .agg(F.sum("value").alias("value"), F.sum("columns").alias("columns"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "v")])
    )
    p, q = _price_of_zero("n_a"), _price_of_zero("n_b")
    zero = summed.withColumns({"p": F.when(F.col("v") > 0, p), "q": F.when(F.col("v") > 0, q)})
    # Terms that no source of the cell has are one more uniform quadrant.
    value = F.col("value") + F.coalesce((F.col("v") - F.col("columns")) * F.expr("(p - q) * (p - q) div (p + q)"), F.lit(0))
    two = F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    both = zero.select("lang", value.alias("value"), F.inline(two))
    terms = priced.where("other is null").select("lang", "value", "source", F.col("term").alias("item"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")),
        terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top),
    ]
    return ranked[0].unionByName(ranked[1])
