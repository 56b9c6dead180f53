"""Packing along a space-filling curve.

Every document is tokenised once; its hashed token counts are projected to a few dimensions
with a seeded matrix, and the cell of that point gets its place on a Hilbert curve.  Documents
are laid end to end in the order of the curve and cut every ``length`` tokens, so neighbours on
the curve share sequences and only the last sequence of all has padding.
"""

from __future__ import annotations

import gc
import itertools
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, running, slices, stored

DIMS = 4
CELL_BITS = 10
HASH_BITS = 12
SEED = 1
#: Scale of a projected mean that spreads most documents over the cells.
SPREAD = 0.35
#: Words and pieces whose ids a Python worker remembers, and characters that it handles at a time.
CACHE_WORDS = 800_000
SLICE = 2_000_000
#: Words that are encoded as one text.
TOGETHER = 500

#: Words of plain Latin letters, with full stops and commas behind: the tokenizer takes the letters
#: (lower-cased one by one) and the signs as two pieces.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")

#: A word of ASCII letters and its signs, or any other word.
PARTS = re.compile(rb"(?:([A-Za-z]+)([.,]*)|([^ ]+))(?: |\Z)")

#: Words by which a vocabulary is tried: cases, letters beyond ASCII, signs.
PROBES = [w.encode() for w in "The house. naïve, Été É., ÀÉ. word.., straße x Zürich, THE a. información".split()]

END = b"\xff"

_loaded: dict[str, tuple] = {}


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for
    themselves, the others for the code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def tokenizer(path: str):
    """The tokenizer of this worker, its remembered words and pieces of words, and whether plain words
    may be put together from pieces: a tokenizer that treats the probes otherwise gets whole words."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model, tried = Tokenizer.from_file(path), Remembered()
        learn(PROBES, model, tried, Remembered(), True)
        in_order = copied(*tried.table(), np.array([tried.place[w] for w in PROBES]))
        same = all(map(np.array_equal, in_order, encoded(PROBES, model)))
        _loaded[path] = (model, Remembered(), Remembered(), same)
    return _loaded[path]


def encoded(words: list[bytes], model) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row and how many each has; many words are one text, whose tokens are told
    apart by where they start."""
    texts = [w.decode("utf-8", "replace") for w in words]
    groups = [texts[a : a + TOGETHER] for a in range(0, len(texts), TOGETHER)]
    ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
    for group, found in zip(groups, model.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        starts = np.cumsum([0] + [len(w) + 1 for w in group])
        of_word = np.searchsorted(starts, [o[0] for o in found.offsets], side="right") - 1
        sizes.append(np.bincount(of_word, minlength=len(group)))
        ids.append(np.array(found.ids, dtype="<u4"))
    return np.concatenate(ids), np.concatenate(sizes)


class Remembered:
    """Ids by word or piece: places in one array of ids, so that an entry costs little beside its key."""

    def __init__(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = [np.zeros(0, dtype="<u4")]
        self.sizes = [np.zeros(0, dtype=np.int64)]

    def add(self, keys: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Remember new keys; returns their places."""
        first = len(self.place)
        self.place.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.ids.append(ids)
        self.sizes.append(sizes)
        return np.arange(first, first + len(keys))

    def places(self, keys) -> np.ndarray:
        """Place of each key, -1 if it is new."""
        return np.fromiter(map(self.place.get, keys, itertools.repeat(-1)), dtype=np.int64, count=len(keys))

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and where each entry begins and how many it has."""
        for parts in (self.ids, self.sizes):
            parts[:] = [np.concatenate(parts)]
        return self.ids[0], np.cumsum(self.sizes[0]) - self.sizes[0], self.sizes[0]


def copied(ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``codes`` one after another, and how many each has."""
    n = sizes[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(first[codes] - (ends - n), n)], n


def plain_parts(words: list[bytes]) -> tuple[list[bytes], list[bytes], list[int]]:
    """Lower-cased letters and signs of each plain word, and which words are not plain.

    A word that is not plain has itself as letters and no signs.
    """
    letters_of, signs, others = map(list, zip(*PARTS.findall(b" ".join(words)), strict=True))
    bases = b" ".join([p or b"-" for p in letters_of]).lower().split(b" ")
    odd = []
    for i in [i for i, p in enumerate(others) if p]:
        word = others[i]
        letters = word.rstrip(b".,")
        found = None if letters.isascii() else PLAIN.fullmatch(letters.decode("utf-8", "replace"))
        if found:
            bases[i], signs[i] = found[0].lower().encode(), word[len(letters) :]
        else:
            bases[i] = word
            odd.append(i)
    return bases, signs, odd


def learn(words: list[bytes], model, known: Remembered, pieces: Remembered, in_pieces: bool) -> np.ndarray:
    """Remember the ids of new words; returns their places.

    Plain words are put together from their pieces, and new pieces go to the merges of the vocabulary
    directly; all other words, and signs, go through the whole tokenizer.
    """
    if not in_pieces:
        return known.add(words, *encoded(words, model))
    bases, signs, odd = plain_parts(words)
    other = set(odd)
    plain = [i for i in range(len(words)) if i not in other] if odd else range(len(words))
    sign_of = [signs[i] for i in plain]
    base_of = [bases[i] for i in plain]
    # Not a difference of sets, which would go through all that is remembered.
    new_signs = sorted(w for w in set(sign_of) if w and w not in pieces.place)
    if b"" not in pieces.place:
        pieces.add([b""], np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64))
    pieces.add(new_signs, *encoded(new_signs, model))
    merge, letters = model.model.tokenize, byte_letters()
    new_bases = [w for w in set(base_of) if w not in pieces.place]
    spelt = [w.decode() if w.isascii() else "".join([letters[b] for b in w]) for w in new_bases]
    merged = [[t.id for t in merge(w)] for w in spelt]
    sizes = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
    pieces.add(new_bases, np.fromiter(itertools.chain.from_iterable(merged), dtype="<u4", count=int(sizes.sum())), sizes)
    table = pieces.table()
    codes = np.empty(2 * len(base_of), dtype=np.int64)
    codes[::2], codes[1::2] = pieces.places(base_of), pieces.places(sign_of)
    ids, n = copied(*table, codes)
    place = np.empty(len(words), dtype=np.int64)
    place[plain] = known.add([words[i] for i in plain] if odd else words, ids, n.reshape(-1, 2).sum(axis=1))
    if odd:
        rest = [words[i] for i in odd]
        place[odd] = known.add(rest, *encoded(rest, model))
    return place


def words_of(joined: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words between ASCII white space, each as its place among the different ones, and those."""
    ends = pa.py_buffer(np.array([0, len(joined)], dtype=np.int64))
    # The bytes need not be UTF-8: they are split at ASCII characters and not looked at otherwise.
    text = pa.LargeStringArray.from_buffers(1, ends, pa.py_buffer(joined))
    words = pc.ascii_split_whitespace(text).flatten().cast(pa.large_binary()).dictionary_encode()
    codes, unique = words.indices.to_numpy().astype(np.int64), words.dictionary.to_numpy(zero_copy_only=False).tolist()
    if b"" in unique:
        # White space at either end and in runs leaves empty words.
        empty = unique.index(b"")
        codes = codes[codes != empty]
        codes -= codes > empty
        del unique[empty]
    return codes, unique


def token_ids(texts: list[bytes], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text's followed by ``end_id``, and their numbers.

    The tokenizer drops white space and never joins across it, so each distinct word between
    ASCII white space is encoded once and its ids are copied wherever it stands.  A byte that no text
    holds stands for the end of a text.
    """
    model, known, pieces, in_pieces = tokenizer(path)
    if len(known.place) + len(pieces.place) > CACHE_WORDS:
        known.__init__()
        pieces.__init__()
    between = b" " + END + b" "
    codes, unique = words_of(between.join(texts) + between)
    own = known.places(unique)
    end = unique.index(END)
    missing = np.flatnonzero(own < 0)
    missing = missing[missing != end]
    if len(missing):
        own[missing] = learn([unique[i] for i in missing.tolist()], model, known, pieces, in_pieces)
    ids, first, sizes = known.table()
    # The end of a text is one more entry.
    ids, first, sizes = np.append(ids, np.uint32(end_id)), np.append(first, len(ids)), np.append(sizes, 1)
    own[end] = len(first) - 1
    found, n = copied(ids, first, sizes, own[codes])
    last = np.cumsum(n)[codes == end]
    return found, np.diff(last, prepend=0)


def forget(path: str) -> None:
    """Leave nothing behind in a worker that other tasks will use."""
    for held in tokenizer(path)[1:3]:
        held.__init__()
    released()


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((1 << HASH_BITS, DIMS))


def points(ids: np.ndarray, lengths: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Cells of the documents: the projected hashed counts, scaled by the normal distribution."""
    hashed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    sums = np.stack([np.add.reduceat(matrix[:, d][hashed], begins) for d in range(matrix.shape[1])], axis=1)
    means = sums / lengths[:, None]
    share = 0.5 * (1 + np.vectorize(math.erf)(means / SPREAD / math.sqrt(2)))
    return np.minimum((share * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in each dimension.

    From the highest bit down, a set bit mirrors what lies below it, and an unset one swaps it with
    the first dimension; the bits of all dimensions are then read as one Gray code.
    """
    x = [cells[:, d].copy() for d in range(cells.shape[1])]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(n):
            is_set = (x[d] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swapped)
            x[d] = x[d] ^ swapped if d else x[0]
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(n):
            place = (place << 1) | (((x[d] ^ flip) >> bit) & 1)
    return place


def tokenised(docs: DataFrame, text: str, path: str, end_id: int, remember: bool = True) -> DataFrame:
    """``docs`` with ``_n`` (tokens), ``_curve`` and ``_ids`` (unsigned, little-endian) for ``text``."""
    rest = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection()
        # Millions of small objects live here and none in cycles: the collector would only walk over them.
        gc.disable()
        try:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
                others = [c for i, c in enumerate(batch.columns) if i != at]
                for a, b in slices(texts, SLICE):
                    ids, lengths = token_ids(texts[a:b], path, end_id)
                    curve = hilbert(points(ids, lengths, matrix), CELL_BITS)
                    raw = ids.tobytes()
                    ends = np.cumsum(lengths) * 4
                    blobs = [raw[e - 4 * n : e] for e, n in zip(ends, lengths, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(a, b - a) for c in others), pa.array(lengths), pa.array(curve), pa.array(blobs, pa.binary())],
                        names=[*rest, "_n", "_curve", "_ids"],
                    )
        finally:
            if not remember:
                forget(path)
            gc.enable()

    schema = docs.select(*rest, F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_curve"), F.lit(b"").alias("_ids")).schema
    return docs.select(*rest, text).mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: list[str] = ("doc_id",), length: int = 2048, end_id: int = 1, remember: bool = True
) -> DataFrame:
    """Cut all documents into sequences of ``length`` tokens, neighbours of the curve together.

    A row for each piece: the ``keep`` columns, ``start`` (tokens of its document before it),
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` (its place there, gapless from 0) and
    ``ids`` (binary, unsigned little-endian 32 bits).  Every document ends with ``end_id``; a null
    text is an empty one and is just that id.  Places of equal rank are told apart by the ``keep``
    columns and the ids, so equal inputs give equal sequences.  Rows that repeat are documents of
    their own; no rows give no rows; other columns are not read.  A worker remembers words from task
    to task; without ``remember`` it forgets them, for jobs whose workers do other things besides.
    """
    renamed = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(r) for c, r in zip(keep, renamed, strict=True)], text)
    made = stored(tokenised(rows, text, tokenizer_path, end_id, remember).withColumn("_rid", F.monotonically_increasing_id()))
    order = made.select("_rid", "_curve", "_n", F.xxhash64(*renamed, "_ids").alias("_tie"), *renamed)
    placed = running(order, ["_curve", *renamed, "_tie", "_rid"], "_n").select("_rid", "before")
    joined = made.select("_rid", *renamed, "_n", "_ids").join(placed, "_rid").drop("_rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(len(renamed)).to_numpy()
            before = batch.column(len(renamed) + 2).to_numpy()
            ids = batch.column(len(renamed) + 1).to_pylist()
            first, last = before // length, (before + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, before[row])
            end = np.minimum((sequence + 1) * length, (before + n)[row])
            start = begin - before[row]
            blobs = [ids[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), (end - before[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).take(pa.array(row)) for i in range(len(renamed))),
                    *map(pa.array, (start, end - begin, n[row], sequence, begin - sequence * length)),
                    pa.array(blobs, pa.binary()),
                ],
                names=[*renamed, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    zero = F.lit(0).cast("long")
    schema = rows.select(
        *renamed, *[zero.alias(c) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], F.lit(b"").alias("ids")
    ).schema
    return joined.mapInArrow(run, schema).withColumnsRenamed(dict(zip(renamed, keep, strict=True)))
