"""Mappings from bit positions to tuples, and tuple addresses of whole tables.

A mapping is a few thousand integers at most (one per input bit and label), so it lives
on the driver and enters plans as one constant.  Rows never get exploded into bits: the
only fan-out is rows x tuples, produced by one generated loop over that constant.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import bit, constant, let
from ..functions.scalars import md5_hex, md5_int, seeded_order

COMPILED_BITS = 128
"""Most bits of an array that is built without a loop."""
SHARED = ""
"""Mapping key that stands for every label."""


@dataclass(frozen=True)
class Mapping:
    """Tuples of bit positions, per label or shared by all labels."""

    entry_size: int
    tuples: dict[str, tuple[tuple[int, ...], ...]]
    base: int = 2
    multi_resolution: bool = False

    @property
    def is_shared(self) -> bool:
        return set(self.tuples) == {SHARED}

    def of(self, label: str) -> tuple[tuple[int, ...], ...]:
        return self.tuples[SHARED] if self.is_shared else self.tuples[label]

    @property
    def n_rams(self) -> int:
        sizes = {len(t) for t in self.tuples.values()}
        if len(sizes) != 1:
            raise ValueError("all labels need the same number of tuples")
        return sizes.pop()

    @property
    def widest(self) -> int:
        return max(len(t) for tuples in self.tuples.values() for t in tuples)

    @property
    def is_wide(self) -> bool:
        """True when an address can reach 2**63 and therefore is kept as a digit string."""
        return self.base**self.widest >= 1 << 63

    def sizes(self, label: str = SHARED) -> list[int]:
        return [len(t) for t in self.of(label)]

    def rows(self) -> list[tuple[str, int, int, int]]:
        return [
            (label, ram, pos, index)
            for label, tuples in sorted(self.tuples.items())
            for ram, tup in enumerate(tuples)
            for pos, index in enumerate(tup)
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        """The mapping as rows ``(label, ram_id, pos, bit_index)``."""
        return spark.createDataFrame(
            self.rows(), "label string, ram_id int, pos int, bit_index int"
        )

    @staticmethod
    def from_table(
        table: DataFrame, entry_size: int, base: int = 2, multi_resolution: bool = False
    ) -> Mapping:
        found: dict[str, dict[int, dict[int, int]]] = {}
        for r in table.select("label", "ram_id", "pos", "bit_index").toLocalIterator():
            found.setdefault(r[0], {}).setdefault(r[1], {})[r[2]] = r[3]
        return Mapping(
            entry_size,
            {
                label: tuple(
                    tuple(pos[p] for p in sorted(pos)) for _, pos in sorted(rams.items())
                )
                for label, rams in found.items()
            },
            base,
            multi_resolution,
        )

    def replaced(self, label: str, tuples) -> Mapping:
        """A copy with the tuples of one label exchanged."""
        return Mapping(
            self.entry_size,
            {**self.tuples, label: tuple(tuple(t) for t in tuples)},
            self.base,
            self.multi_resolution,
        )


def _indexes(entry_size: int, indexes) -> list[int]:
    return list(range(entry_size)) if indexes is None else list(indexes)


def _cut(order: list[int], tuple_size: int, complete: bool, prefix: str) -> tuple:
    """Slice an ordering into tuples; the remainder is padded with repeats or dropped."""
    rest = len(order) % tuple_size
    if rest and complete:
        pool = sorted(order)
        order = order + [
            pool[md5_int(f"{prefix}:pad:{j}") % len(pool)] for j in range(tuple_size - rest)
        ]
    whole = len(order) // tuple_size
    return tuple(tuple(order[r * tuple_size : (r + 1) * tuple_size]) for r in range(whole))


def random_mapping(
    entry_size: int,
    tuple_size: int,
    seed: int,
    labels: list[str] | None = None,
    complete: bool = True,
    indexes=None,
    base: int = 2,
) -> Mapping:
    """Shuffled tuples: one mapping per label, or one for all when ``labels`` is None.

    The shuffle orders bit positions by ``md5("seed:label:i")`` (``md5("seed:i")`` when
    shared), so any SQL engine can rebuild it.
    """
    pool = _indexes(entry_size, indexes)
    if tuple_size < 1 or tuple_size > len(pool):
        raise ValueError("tuple size must be between 1 and the number of bit positions")
    keys = [SHARED] if labels is None else labels
    tuples = {}
    for label in keys:
        prefix = f"{seed}" if labels is None else f"{seed}:{label}"
        tuples[label] = _cut(seeded_order(pool, prefix), tuple_size, complete, prefix)
    return Mapping(entry_size, tuples, base)


def ordered_mapping(
    entry_size: int, tuple_size: int, complete: bool = True, indexes=None, base: int = 2
) -> Mapping:
    """Consecutive bit positions, unshuffled."""
    pool = _indexes(entry_size, indexes)
    return Mapping(entry_size, {SHARED: _cut(pool, tuple_size, complete, "ordered")}, base)


def explicit_mapping(entry_size: int, tuples, base: int = 2) -> Mapping:
    """Tuples given by the user: a list for all labels, or a dict per label."""
    per_label = tuples if isinstance(tuples, dict) else {SHARED: tuples}
    for group in per_label.values():
        for tup in group:
            if any(i < 0 or i >= entry_size for i in tup):
                raise ValueError("mapping refers to a bit outside the entry")
    return Mapping(
        entry_size, {k: tuple(tuple(t) for t in v) for k, v in per_label.items()}, base
    )


def multi_resolution_sizes(entry_size: int, tuple_size: int, complete: bool = True) -> list[int]:
    """Tuple sizes spread evenly over [max(2, n/2), 3n/2] whose sum is the entry size."""
    count = max(1, entry_size // tuple_size)
    if complete and entry_size % tuple_size:
        count += 1
    if count == 1:
        return [entry_size]
    low = max(2, tuple_size // 2)
    high = max(low, tuple_size * 3 // 2)
    sizes = [int(low + i / (count - 1) * (high - low) + 0.5) for i in range(count)]
    missing = entry_size - sum(sizes)
    if missing >= 0:
        # Equal shares; what is left over goes to the last tuples.
        return [size + (missing + i) // count for i, size in enumerate(sizes)]
    # No tuple is cut below two bits.  All are cut down by the same number of bits, as far as
    # their room allows; what then still has to go is taken from the first tuples with room.
    room = [max(size - 2, 0) for size in sizes]
    level = max(k for k in range(max(room) + 1) if sum(min(k, r) for r in room) <= -missing)
    rest = -missing - sum(min(level, r) for r in room)
    one_more = [i for i, r in enumerate(room) if r > level][:rest]
    return [size - min(level, r) - (i in one_more) for i, (size, r) in enumerate(zip(sizes, room, strict=True))]


def multi_resolution_mapping(
    entry_size: int,
    tuple_size: int,
    seed: int,
    labels: list[str] | None = None,
    complete: bool = True,
) -> Mapping:
    """Tuples of mixed sizes over a shuffled entry."""
    sizes = multi_resolution_sizes(entry_size, tuple_size, complete)
    tuples = {}
    for label in [SHARED] if labels is None else labels:
        prefix = f"{seed}" if labels is None else f"{seed}:{label}"
        shuffled = [sizes[i] for i in seeded_order(range(len(sizes)), f"{prefix}:size")]
        order = seeded_order(range(entry_size), prefix)
        start, group = 0, []
        for size in shuffled:
            if start >= entry_size:
                break
            group.append(tuple(order[start : start + size]))
            start += size
        tuples[label] = tuple(group)
    return Mapping(entry_size, tuples, 2, True)


def local_2d_mapping(
    height: int,
    width: int,
    bits_per_pixel: int,
    window_height: int,
    window_width: int,
    tuple_size: int,
    seed: int,
    stride: int = 0,
    rams_per_window: int = 1,
    labels: list[str] | None = None,
) -> Mapping:
    """Random tuples inside sliding image windows; stride 0 means the smaller window side."""
    if window_height > height or window_width > width:
        raise ValueError("the window must fit inside the image")
    if not 2 <= tuple_size <= window_height * window_width * bits_per_pixel:
        raise ValueError("the tuple must have at least 2 bits and fit inside the window")
    step = stride or min(window_height, window_width)
    tuples = {}
    for label in [SHARED] if labels is None else labels:
        prefix = f"{seed}" if labels is None else f"{seed}:{label}"
        group = []
        for top in range(0, height - window_height + 1, step):
            for left in range(0, width - window_width + 1, step):
                cells = [
                    ((top + dh) * width + left + dw) * bits_per_pixel + k
                    for dh in range(window_height)
                    for dw in range(window_width)
                    for k in range(bits_per_pixel)
                ]
                for _ in range(rams_per_window):
                    order = seeded_order(cells, f"{prefix}:{len(group)}")
                    group.append(tuple(order[:tuple_size]))
        tuples[label] = tuple(group)
    return Mapping(height * width * bits_per_pixel, tuples)


def stacked_permutations(
    input_size: int, tuple_size: int, n_luts: int, seed: int | None
) -> Mapping:
    """Permutations laid end to end and cut into ``n_luts`` tuples; in order without a seed."""
    need = tuple_size * n_luts
    cells: list[int] = []
    number = 0
    while len(cells) < need:
        cells += (
            list(range(input_size))
            if seed is None
            else seeded_order(range(input_size), f"{seed}:{number}")
        )
        number += 1
    return Mapping(
        input_size,
        {SHARED: tuple(tuple(cells[i : i + tuple_size]) for i in range(0, need, tuple_size))},
    )


def padded_permutation(n_inputs: int, tuple_size: int, seed: int) -> Mapping:
    """A permutation over the entry extended by constant-zero bits to whole tuples.

    Positions from ``n_inputs`` on lie outside the bit array and read as zero.
    """
    total = -(-n_inputs // tuple_size) * tuple_size
    order = sorted(range(total), key=lambda i: md5_hex(f"{seed}:{i}"))
    return Mapping(
        total,
        {SHARED: tuple(tuple(order[i : i + tuple_size]) for i in range(0, total, tuple_size))},
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``; unlabelled rows are left out."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("string").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_counts(df: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per label, in label order.  A row for each label comes to the driver: scores are arrays over
    the labels anyway, so a model has as many as a row can hold."""
    rows = label_counts(df, label).collect()
    return {r["label"]: r["n"] for r in sorted(rows, key=lambda r: r["label"].encode())}


# ---------------------------------------------------------------------------
# Bit sources
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class BitColumn:
    """Bits (or base-b digits) that already exist as an array column."""

    name: str = "bits"

    def columns(self) -> list[str]:
        return [self.name]

    def plan(self, index: int) -> dict:
        return {"i": index}

    plan_fields = "i:int"

    def digit(self, p: Column | dict, row: Column | None = None) -> Column:
        source = F.col(self.name) if row is None else row
        index = p["i"] if isinstance(p["i"], Column) else F.lit(p["i"])
        short = F.raise_error(F.lit("a row has fewer bits than the mapping refers to")).cast("bigint")
        # Tuples shorter than the widest one have no index in their last places.
        return F.when(index.isNull(), F.lit(0).cast("bigint")).otherwise(
            F.coalesce(F.get(source, index).cast("bigint"), short)
        )


@dataclass(frozen=True)
class ThresholdBits:
    """Bits defined by one comparison each: ``features[feature] > threshold``.

    Addresses are computed straight from the numeric column; the bit array is never built.
    """

    name: str
    specs: tuple[tuple[int, float], ...]
    strict: bool = True

    def columns(self) -> list[str]:
        return [self.name]

    def plan(self, index: int) -> dict:
        if index >= len(self.specs):
            return {"f": -1, "t": 0.0}
        feature, threshold = self.specs[index]
        return {"f": feature, "t": threshold}

    plan_fields = "f:int,t:double"

    def digit(self, p: Column | dict, row: Column | None = None) -> Column:
        source = F.col(self.name) if row is None else row
        value = F.get(source, p["f"])
        hit = value > p["t"] if self.strict else value >= p["t"]
        return bit(hit).cast("bigint")

    def bits(self) -> Column:
        """The bit array itself; few bits are compiled comparisons, many a loop over a constant."""
        if len(self.specs) <= COMPILED_BITS:
            return F.array(*[self.digit({"f": F.lit(f), "t": F.lit(t)}).cast("tinyint") for f, t in self.specs])
        specs = constant(
            [{"f": f, "t": t} for f, t in self.specs], "array<struct<f:int,t:double>>"
        )
        return F.transform(specs, lambda p: self.digit(p, F.col(self.name)).cast("tinyint"))


BitSource = BitColumn | ThresholdBits


# ---------------------------------------------------------------------------
# Addresses
# ---------------------------------------------------------------------------


def tuple_rows(
    df: DataFrame,
    mapping: Mapping,
    bits: BitSource,
    keep: list[str],
    label: str | None = None,
    model_label: str = "label",
) -> DataFrame:
    """One row per input row and tuple: ``keep..., ram_id, address``.

    With a shared mapping every row yields its tuples once.  With per-label mappings,
    ``label`` names the column that selects the tuples of a row (training); without it the
    row yields the tuples of every label and ``model_label`` says which (scoring).
    """
    per_label = not mapping.is_shared
    width = mapping.widest
    wide = mapping.is_wide
    plan = []
    for key, tuples in sorted(mapping.tuples.items()):
        for ram, tup in enumerate(tuples):
            if wide:
                cells = {"p": [bits.plan(i) for i in tup]}
            else:
                cells = {
                    f"p{j}": {**bits.plan(i), "w": mapping.base**j} for j, i in enumerate(tup)
                }
            plan.append({"label": key, "ram": ram, **cells})
    if wide:
        body = f"p:array<struct<{bits.plan_fields}>>"
    else:
        body = ",".join(f"p{j}:struct<{bits.plan_fields},w:bigint>" for j in range(width))
    table = constant(plan, f"array<struct<label:string,ram:int,{body}>>")
    if per_label and label is not None:
        wanted = F.col(label)
        groups = {key: [p for p in plan if p["label"] == key] for key in mapping.tuples}
        table = F.element_at(
            constant(
                list(groups.values()),
                f"array<array<struct<label:string,ram:int,{body}>>>",
            ),
            F.array_position(constant(list(groups), "array<string>"), wanted).cast("int"),
        )
        df = df.where(wanted.isin(list(groups)))
    source = [c for c in bits.columns() if c not in keep]
    out = df.select(*keep, *source, F.explode(table).alias("_m"))
    if wide:
        address = F.array_join(
            F.transform("_m.p", lambda p: bits.digit(p).cast("string")), ""
        )
    else:
        address = reduce(
            lambda a, b: a + b,
            [
                bits.digit(_fields(f"_m.p{j}", bits)) * F.coalesce(F.col(f"_m.p{j}.w"), F.lit(0).cast("bigint"))
                for j in range(width)
            ],
        )
    extra = [F.col("_m.label").alias(model_label)] if per_label and label is None else []
    return out.select(*keep, *extra, F.col("_m.ram").alias("ram_id"), address.alias("address"))


def _fields(path: str, bits: BitSource) -> dict:
    names = [field.split(":")[0] for field in bits.plan_fields.split(",")]
    return {n: F.col(f"{path}.{n}") for n in names}


def tuple_addresses(mapping: Mapping, bits: BitSource, label: str = SHARED) -> Column:
    """All addresses of one row as ``array<bigint>``, ordered by tuple."""
    if mapping.is_wide:
        raise ValueError("wide addresses exist only in the exploded form")
    plan = constant(
        [
            [{**bits.plan(i), "w": mapping.base**j} for j, i in enumerate(tup)]
            for tup in mapping.of(label)
        ],
        f"array<array<struct<{bits.plan_fields},w:bigint>>>",
    )
    return let(F.col(bits.columns()[0]), lambda row: F.transform(plan, lambda tup: _address(tup, bits, row)))


def _address(tup: Column, bits: BitSource, row: Column) -> Column:
    return F.aggregate(
        tup, F.lit(0).cast("bigint"), lambda acc, p: acc + bits.digit(p, row) * p["w"]
    )


def slot_numbers(mapping: Mapping, bits: BitSource, labels: list[str]) -> Column:
    """Dense positions of one row as ``array<int>``: one per tuple of a shared mapping, else
    one per tuple and label (tuple-major).  A row's votes depend on nothing else."""
    offsets = slot_offsets(mapping, labels)
    fields = f"o:bigint,p:array<struct<{bits.plan_fields},w:bigint>>"
    keys = [SHARED] if mapping.is_shared else labels
    plan = constant(
        [
            {
                "o": offsets[(key, ram)],
                "p": [
                    {**bits.plan(i), "w": mapping.base**j} for j, i in enumerate(mapping.of(key)[ram])
                ],
            }
            for ram in range(mapping.n_rams)
            for key in keys
        ],
        f"array<struct<{fields}>>",
    )

    def slot(e: Column, row: Column) -> Column:
        return F.aggregate(
            e["p"], e["o"], lambda acc, p: acc + bits.digit(p, row) * p["w"]
        ).cast("int")

    return let(
        F.col(bits.columns()[0]), lambda row: F.transform(plan, lambda e: slot(e, row))
    )


def address_pattern(mapping: Mapping, bits: BitSource, labels: list[str]) -> Column:
    """All addresses of one row in an array: one per tuple of a shared mapping, else one per
    tuple and label (tuple-major).  Wide addresses are strings."""
    keys = [SHARED] if mapping.is_shared else labels
    plan = constant(
        [
            [{**bits.plan(i), "w": 0 if mapping.is_wide else mapping.base**j} for j, i in enumerate(mapping.of(key)[ram])]
            for ram in range(mapping.n_rams)
            for key in keys
        ],
        f"array<array<struct<{bits.plan_fields},w:bigint>>>",
    )

    def one(tup: Column, row: Column) -> Column:
        if mapping.is_wide:
            return F.array_join(F.transform(tup, lambda p: bits.digit(p, row).cast("string")), "")
        return _address(tup, bits, row)

    return let(F.col(bits.columns()[0]), lambda row: F.transform(plan, lambda tup: one(tup, row)))


def slot_votes(mapping: Mapping, labels: list[str], cells: Column, slots: Column) -> Column:
    """Votes ``array<array<int>>`` (tuple, then label) at the given dense positions.

    ``cells`` is a constant: for a shared mapping an array of count vectors, for per-label
    mappings a flat array of counts.
    """
    if mapping.is_shared:
        return F.transform(slots, lambda s: F.get(cells, s))
    size = len(labels)
    rams = constant(list(range(mapping.n_rams)), "array<int>")
    return let(
        F.transform(slots, lambda s: F.get(cells, s)),
        lambda flat: F.transform(rams, lambda r: F.slice(flat, r * size + 1, size)),
    )


def slot_offsets(mapping: Mapping, labels: list[str]) -> dict[tuple[str, int], int]:
    """First dense cell of each (label, tuple); label is "" for a shared mapping."""
    offsets, total = {}, 0
    for label in [SHARED] if mapping.is_shared else labels:
        for ram, size in enumerate(mapping.sizes(label)):
            offsets[(label, ram)] = total
            total += mapping.base**size
    return offsets


def slot_count(mapping: Mapping, labels: list[str]) -> int:
    keys = [SHARED] if mapping.is_shared else labels
    return sum(mapping.base**size for label in keys for size in mapping.sizes(label))


def reverse_digit(address: Column, pos: Column | int, base: int) -> Column:
    """Digit ``pos`` of an integer address."""
    place = F.pow(F.lit(base), pos).cast("bigint")
    return F.pmod(F.floor(address / place).cast("bigint"), F.lit(base)) if base != 2 else F.getbit(
        address, pos if isinstance(pos, Column) else F.lit(pos)
    ).cast("bigint")
