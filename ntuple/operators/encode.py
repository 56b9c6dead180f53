"""Encoders: numeric features to bits.

Fitting is an aggregate job whose result, one threshold list per feature, is small and is
kept on the driver; applying it is a projection.  ``features`` is an array column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import bit, constant, let
from ..functions.joins import lookup_join
from ..functions.scalars import md5_unit, normal_quantile
from .address import ThresholdBits, class_counts
from .order import global_ranks, order_statistics, rank_bins


RANK_BIN_ROWS = 1_000_000
"""Aimed rows of a rank bin, the part of a feature that one task orders."""
GOAL_SLACK = 1e-6


@dataclass(frozen=True)
class Thermometer:
    """Per-feature thresholds (possibly of unequal number); bit = value > threshold."""

    thresholds: tuple[tuple[float, ...], ...]
    strict: bool = True

    @staticmethod
    def of(lists, strict: bool = True) -> Thermometer:
        return Thermometer(tuple(tuple(float(t) for t in ts) for ts in lists), strict)

    @property
    def sizes(self) -> list[int]:
        return [len(ts) for ts in self.thresholds]

    @property
    def n_bits(self) -> int:
        return sum(self.sizes)

    def on(self, features: str) -> ThresholdBits:
        """The bits as comparisons on a feature column, feature-major."""
        return ThresholdBits(
            features,
            tuple((f, t) for f, ts in enumerate(self.thresholds) for t in ts),
            self.strict,
        )

    def bits(self, features: str) -> Column:
        return self.on(features).bits()

    def rounded(self, digits: int) -> Thermometer:
        return Thermometer.of([[round(t, digits) for t in ts] for ts in self.thresholds], self.strict)

    def replaced(self, feature: int, k: int, value: float) -> Thermometer:
        lists = [list(ts) for ts in self.thresholds]
        lists[feature][k] = value
        return Thermometer.of(lists, self.strict)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, k, t) for f, ts in enumerate(self.thresholds) for k, t in enumerate(ts)]
        return spark.createDataFrame(rows, "feature int, k int, threshold double")

    @staticmethod
    def from_table(table: DataFrame) -> Thermometer:
        lists: dict[int, dict[int, float]] = {}
        for r in table.select("feature", "k", "threshold").toLocalIterator():
            lists.setdefault(r[0], {})[r[1]] = r[2]
        return Thermometer.of([[ks[k] for k in sorted(ks)] for _, ks in sorted(lists.items())])


def long_features(df: DataFrame, features: str, keep: list[str] | None = None) -> DataFrame:
    """Rows ``(keep..., feature, value)``; only the feature column and ``keep`` are read."""
    return df.select(*(keep or []), F.posexplode(features).alias("feature", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def finite(features: Column | str) -> Column:
    """Features with null for NaN and infinite values; fits leave nulls out."""
    return F.transform(features, lambda x: F.when(F.abs(x) < F.lit(float("inf")), x))


def feature_statistics(df: DataFrame, features: str) -> list:
    """Mean, sample deviation, minimum, maximum and count of every feature, in one pass."""
    return (
        long_features(df, features)
        .groupBy("feature")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count("value").alias("n"),
        )
        .orderBy("feature")
        .collect()
    )


@contextmanager
def stored_rows(df: DataFrame) -> Iterator[DataFrame]:
    """Keep rows that a fit scans many times, for the duration of the fit."""
    rows = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


# -- encoders without fitting -----------------------------------------------


def constant_threshold(features: Column | str, threshold: float) -> Column:
    """bit = value >= threshold."""
    return F.transform(features, lambda x: bit(x >= F.lit(threshold)).cast("tinyint"))


def row_mean_threshold(features: Column | str) -> Column:
    """bit = value >= mean of its row."""
    source = F.col(features) if isinstance(features, str) else features
    return let(
        source,
        lambda xs: let(
            F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs),
            lambda mean: F.transform(xs, lambda x: bit(x >= mean).cast("tinyint")),
        ),
    )


def fixed_thermometer(
    n_features: int, bits: int = 2, low: float = 0.0, high: float = 1.0
) -> Thermometer:
    """Equal steps from ``low`` (included) to ``high`` (excluded)."""
    return ragged_thermometer([bits] * n_features, [low] * n_features, [high] * n_features)


def ragged_thermometer(sizes, lows=None, highs=None) -> Thermometer:
    """Number of bits and range per feature."""
    lows = lows or [0.0] * len(sizes)
    highs = highs or [1.0] * len(sizes)
    return Thermometer.of(
        [
            [lo + k * ((hi - lo) / b) for k in range(b)]
            for b, lo, hi in zip(sizes, lows, highs, strict=True)
        ]
    )


def circular_bits(
    features: Column | str, bits: int = 32, low: float = 0.0, high: float = 2 * math.pi
) -> Column:
    """Periodic values: bit j is set within a quarter period of centre j/B of the circle."""
    period = high - low
    if period <= 0:
        raise ValueError("the period must be positive")
    centres = constant([j / bits * period for j in range(bits)], "array<double>")
    source = F.col(features) if isinstance(features, str) else features

    def one(x: Column) -> Column:
        shifted = x - F.lit(low)
        wrapped = shifted - F.floor(shifted / F.lit(period)) * F.lit(period)
        return let(
            wrapped,
            lambda v: F.transform(
                centres,
                lambda c: bit(
                    F.least(F.abs(v - c), F.lit(period) - F.abs(v - c)) < F.lit(period / 4)
                ).cast("tinyint"),
            ),
        )

    return F.flatten(F.transform(source, one))


def color_masks(
    r: Column,
    g: Column,
    b: Column,
    red_min: float = 0.5,
    red_gap: float = 0.10,
    white_min: float = 0.75,
    dark_max: float = 0.20,
) -> list[Column]:
    """Red, white and dark flags of a pixel row."""
    red = (r > red_min) & (r - g > red_gap) & (r - b > red_gap)
    white = (r > white_min) & (g > white_min) & (b > white_min)
    dark = (r < dark_max) & (g < dark_max) & (b < dark_max)
    return [bit(red).alias("red"), bit(white).alias("white"), bit(dark).alias("dark")]


def concat_bits(*bits: str) -> Column:
    """One entry from several encoded columns."""
    return F.concat(*bits)


def get_bit(bits: str, index: int) -> Column:
    return F.get(bits, F.lit(index))


def set_bit(bits: str, index: int, value: int) -> Column:
    return F.transform(
        bits,
        lambda x, i: F.when(i == index, F.lit(value)).otherwise(x.cast("int")).cast("tinyint"),
    )


# -- fitted encoders --------------------------------------------------------


def fit_gaussian(df: DataFrame, features: str, bits: int = 32) -> Thermometer:
    """mean + deviation * normal quantile of (k+1)/(B+1)."""
    q = [normal_quantile((k + 1) / (bits + 1)) for k in range(bits)]
    return Thermometer.of(
        [[s["mean"] + (s["std"] or 0.0) * z for z in q] for s in feature_statistics(df, features)]
    )


def fit_gaussian_clamped(df: DataFrame, features: str, bits: int) -> Thermometer:
    """The same quantiles with the deviation kept at 1e-6 or more."""
    q = [normal_quantile((k + 1) / (bits + 1)) for k in range(bits)]
    return Thermometer.of(
        [
            [s["mean"] + max(s["std"] or 0.0, 1e-6) * z for z in q]
            for s in feature_statistics(df, features)
        ]
    )


def fit_exponential(df: DataFrame, features: str, bits: int = 32) -> Thermometer:
    """Quantiles of an exponential distribution with the feature's mean; 0 for mean <= 0."""
    q = [-math.log(1 - (k + 1) / (bits + 1)) for k in range(bits)]
    return Thermometer.of(
        [[max(s["mean"], 0.0) * z for z in q] for s in feature_statistics(df, features)]
    )


def fit_logarithmic(df: DataFrame, features: str, bits: int = 32) -> Thermometer:
    """Steps of equal ratio between minimum and maximum, shifted to be positive."""
    out = []
    for s in feature_statistics(df, features):
        shift = 1.0 - s["min"] if s["min"] <= 0 else 0.0
        low, high = s["min"] + shift, s["max"] + shift
        if high <= low:
            high = low + 1e-9
        a, b = math.log(low), math.log(high)
        out.append(
            [math.exp(a + (k + 1) / (bits + 1) * (b - a)) - shift for k in range(bits)]
        )
    return Thermometer.of(out)


def fit_linear(df: DataFrame, features: str, bits: int) -> Thermometer:
    """Inner points of an even grid between training minimum and maximum."""
    return Thermometer.of(
        [
            [s["min"] + i * (s["max"] - s["min"]) / (bits + 1) for i in range(1, bits + 1)]
            for s in feature_statistics(df, features)
        ]
    )


def percentile_rank(k: int, bits: int, n: int) -> int:
    return min(n - 1, int((k + 1) / (bits + 1) * (n - 1)))


def fit_percentile(df: DataFrame, features: str, bits: int = 32) -> Thermometer:
    """Order statistics at rank floor((k+1)/(B+1) * (n-1)); also the start of threshold search."""
    found = order_statistics(
        long_features(df, features),
        ["feature"],
        "value",
        lambda _key, n: [percentile_rank(k, bits, n) for k in range(bits)],
    )
    return Thermometer.of([[s.value for s in found[key]] for key in sorted(found)])


def fit_percentile_count(
    df: DataFrame, features: str, bits: int, per_feature: bool = True
) -> Thermometer:
    """Order statistics at rank int(n*i/(B+1)), per feature or over all values together."""
    values = long_features(df, features)
    ranks = lambda _key, n: [int(n * i / (bits + 1)) for i in range(1, bits + 1)]
    if per_feature:
        found = order_statistics(values, ["feature"], "value", ranks)
        return Thermometer.of([[s.value for s in found[key]] for key in sorted(found)])
    pooled = order_statistics(values.select("value"), [], "value", ranks)[()]
    n_features = len(feature_statistics(df, features))
    return Thermometer.of([[s.value for s in pooled]] * n_features)


def fit_class_conditional(
    df: DataFrame, features: str, label: str, bits: int
) -> Thermometer:
    """Quantiles of each class; the bits are dealt to the classes in label order."""
    values = long_features(df, features, [label])
    labels = list(class_counts(df, label))
    share, extra = divmod(bits, len(labels))
    quota = {lab: share + (1 if i < extra else 0) for i, lab in enumerate(labels)}
    found = order_statistics(
        values,
        ["feature", label],
        "value",
        lambda key, n: [percentile_rank(k, quota[key[1]], n) for k in range(quota[key[1]])],
    )
    merged: dict[int, list[float]] = {}
    for (feature, _), stats in found.items():
        merged.setdefault(feature, []).extend(s.value for s in stats)
    return Thermometer.of([sorted(merged[f]) for f in sorted(merged)])


def mutual_information(
    df: DataFrame, features: str, label: str, row_id: str, bins: int
) -> DataFrame:
    """Mutual information (bits) of each feature's equal-frequency bin with the label."""
    values = long_features(df, features, [row_id, label])
    binned = rank_bins(values, ["feature"], "value", row_id, bins)
    cells = binned.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("c"))
    by_feature = W.partitionBy("feature")
    p = F.col("c") / F.sum("c").over(by_feature)
    px = F.sum("c").over(W.partitionBy("feature", "bin")) / F.sum("c").over(by_feature)
    py = F.sum("c").over(W.partitionBy("feature", label)) / F.sum("c").over(by_feature)
    return (
        cells.select("feature", (p * F.log2(p / (px * py))).alias("part"))
        .groupBy("feature")
        .agg(F.sum("part").alias("mi"))
    )


def allocate_bits(scores: list[float], budget: int, floor: int) -> list[int]:
    """Bits per feature: a floor, then shares of the score by largest remainder."""
    n = len(scores)
    total = sum(scores)
    if floor * n >= budget or total <= 0:
        share, extra = divmod(budget, n)
        return [share + (1 if f < extra else 0) for f in range(n)]
    spare = budget - floor * n
    exact = [s / total * spare for s in scores]
    sizes = [floor + int(e) for e in exact]
    order = sorted(range(n), key=lambda f: (-(exact[f] - int(exact[f])), f))
    for f in order[: budget - sum(sizes)]:
        sizes[f] += 1
    return sizes


def fit_mi_allocation(
    df: DataFrame, features: str, label: str, row_id: str, bits: int, min_bits: int = 1
) -> Thermometer:
    """Percentile thresholds, more of them for features that tell the classes apart."""
    with stored_rows(df.select(row_id, label, features)) as rows:
        found = mutual_information(rows, features, label, row_id, bits).orderBy("feature").collect()
        scores = [round(max(r["mi"], 0.0), 9) for r in found]
        sizes = allocate_bits(scores, bits * len(scores), min_bits)
        stats = order_statistics(
            long_features(rows, features),
            ["feature"],
            "value",
            lambda key, n: [percentile_rank(k, sizes[key[0]], n) for k in range(sizes[key[0]])],
        )
    return Thermometer.of([[s.value for s in stats[(f,)]] for f in range(len(sizes))])


def fit_entropy_weighted(
    df: DataFrame, features: str, label: str, row_id: str, bits: int, n_bins: int | None = None
) -> Thermometer:
    """Thresholds where the classes overlap: equal shares of windowed label entropy.

    The label counts of a rank window are differences of running counts, fetched by two
    equi-joins on ``(feature, rank)``; running sums are taken inside balanced rank bins and
    shifted by the bins before, so no task sees a whole feature.  The number of bins grows
    with the rows unless it is given.
    """
    with stored_rows(df.select(row_id, label, features)) as rows:
        return _entropy_weighted(rows, features, label, row_id, bits, n_bins)


def _entropy_weighted(
    df: DataFrame, features: str, label: str, row_id: str, bits: int, n_bins: int | None
) -> Thermometer:
    sizes = class_counts(df, label)
    n, labels = sum(sizes.values()), list(sizes)
    n_bins = n_bins or max(16, n // RANK_BIN_ROWS)
    names = [f"c{i}" for i in range(len(labels))]
    flags = [
        bit(F.col(label) == lab).cast("bigint").alias(c) for c, lab in zip(names, labels, strict=True)
    ]
    ranked = global_ranks(
        long_features(df, features, [row_id, label]), ["feature"], "value", row_id, n_bins
    ).select("feature", "value", "rank", "rank_bin", *flags)
    with stored_rows(ranked) as ranks:
        running = running_sums(ranks, ["feature"], "rank_bin", "rank", names)
        with stored_rows(running) as sums, stored_rows(_window_entropy(sums, names, n)) as weights:
            return _equal_weight_thresholds(df, features, weights, bits)


def _window_entropy(running: DataFrame, names: list[str], n: int) -> DataFrame:
    """Label entropy of the rank window of each row: ``(feature, value, rank, rank_bin, e)``.

    Counts inside a window are the running counts at its end minus those before it.
    """
    window = min(max(10, math.isqrt(n)), n // 4)
    half = window // 2
    i = F.col("rank")
    lo = F.greatest(i - half, F.lit(0))
    hi = F.least(i + half + 1, F.lit(n))
    cut = (hi - lo) > window
    spans = running.select(
        "feature",
        "value",
        "rank",
        "rank_bin",
        F.when(cut & (lo != 0), hi - window).otherwise(lo).alias("lo"),
        F.when(cut & (lo == 0), F.lit(window)).otherwise(hi).alias("hi"),
    )
    after = F.col("rank") + 1
    upper = running.select("feature", after.alias("hi"), *[F.col(c).alias(f"h{c}") for c in names])
    lower = running.select("feature", after.alias("lo"), *[F.col(c).alias(f"l{c}") for c in names])
    joined = spans.join(upper, ["feature", "hi"]).join(lower, ["feature", "lo"], "left")
    size = F.col("hi") - F.col("lo")
    entropy = F.lit(0.0)
    for c in names:
        count = F.col(f"h{c}") - F.coalesce(F.col(f"l{c}"), F.lit(0))
        p = count / size
        entropy = entropy - F.when(count > 0, p * F.log2(p)).otherwise(F.lit(0.0))
    return joined.select("feature", "value", "rank", "rank_bin", entropy.alias("e"))


def _equal_weight_thresholds(
    df: DataFrame, features: str, entropies: DataFrame, bits: int
) -> Thermometer:
    """Values where the running weight (entropy plus a floor) passes equal shares."""
    tops = entropies.groupBy("feature").agg(F.max("e").alias("top")).collect()
    floors = {r["feature"]: 0.01 * r["top"] if r["top"] > 0 else 1.0 for r in tops}
    order = sorted(floors)
    floor = F.get(constant([floors[f] for f in order], "array<double>"), F.col("feature"))
    own = F.col("e") + floor
    weighted = entropies.select("feature", "value", "rank", "rank_bin", own.alias("own"), own.alias("w"))
    cumulative = running_sums(weighted, ["feature"], "rank_bin", "rank", ["w"])
    totals = {r["feature"]: r["t"] for r in weighted.groupBy("feature").agg(F.sum("w").alias("t")).collect()}
    goals = constant(
        [[(k + 1) / (bits + 1) * totals[f] for k in range(bits)] for f in order],
        "array<array<double>>",
    )
    # Goals that a row passes lie between the sums before and after it; the slack, in goals, covers the
    # rounding of sums.  The first row at or above a goal is always among those that name it.
    unit = F.get(constant([(bits + 1) / totals[f] for f in order], "array<double>"), F.col("feature"))
    low = F.greatest(F.floor((F.col("w") - F.col("own")) * unit - GOAL_SLACK), F.lit(0))
    high = F.least(F.floor(F.col("w") * unit + GOAL_SLACK), F.lit(bits))
    picked = (
        cumulative.select("feature", "value", "rank", "w", low.cast("int").alias("low"), high.cast("int").alias("high"))
        .where("high > low")
        .select("feature", "value", "rank", "w", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
        .where(F.col("w") >= F.get(F.get(goals, F.col("feature")), F.col("k")))
        .groupBy("feature", "k")
        .agg(F.min_by("value", "rank").alias("threshold"))
        .collect()
    )
    found = {(r["feature"], r["k"]): r["threshold"] for r in picked}
    last = {r["feature"]: r["max"] for r in feature_statistics(df, features)}
    return Thermometer.of([[found.get((f, k), last[f]) for k in range(bits)] for f in order])


def running_sums(
    df: DataFrame, keys: list[str], bin_col: str, order: str, columns: list[str]
) -> DataFrame:
    """Inclusive running sums in ``order``: within bins, plus the totals of the bins before."""
    per_bin = df.groupBy(*keys, bin_col).agg(*[F.sum(c).alias(f"_s{c}") for c in columns])
    before = W.partitionBy(*keys).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    shifts = per_bin.select(
        *keys,
        bin_col,
        *[F.coalesce(F.sum(f"_s{c}").over(before), F.lit(0)).alias(f"_o{c}") for c in columns],
    )
    within = W.partitionBy(*keys, bin_col).orderBy(order)
    others = [c for c in df.columns if c not in columns]
    return df.join(F.broadcast(shifts), [*keys, bin_col]).select(
        *others, *[(F.sum(c).over(within) + F.col(f"_o{c}")).alias(c) for c in columns]
    )


# -- sequences --------------------------------------------------------------


def kernel_table(n_kernels: int, dim: int, seed: int) -> list[list[float]]:
    """Kernel centres, uniform in [-1, 1)."""
    return [
        [2 * md5_unit(f"kernel:{seed}:{i}:{d}") - 1 for d in range(dim)] for i in range(n_kernels)
    ]


def squashed_points(
    df: DataFrame, seq: str, pos: str, dims: list[str], bucket: Column | None = None
) -> DataFrame:
    """Points of each sequence as ``point`` arrays: tanh of the centred, scaled coordinates.

    A flat coordinate yields 0.  With ``bucket``, the direction mode: the unit vector to the
    next point is appended, and the last point of a sequence repeats the vector of the one
    before.  ``bucket`` must grow with ``pos`` (a day, say); neighbours are looked up inside
    a bucket and, at its ends, in a table of first and last points, so that one long
    sequence spreads over many tasks.
    """
    stats = df.groupBy(seq).agg(
        *[F.avg(d).alias(f"_m{d}") for d in dims],
        *[F.stddev_pop(d).alias(f"_s{d}") for d in dims],
    )
    z = [
        F.when(F.col(f"_s{d}") > 0, F.tanh((F.col(f"_m{d}") - F.col(d)) / F.col(f"_s{d}")))
        .otherwise(F.lit(0.0))
        for d in dims
    ]
    extra = [] if bucket is None else [bucket.alias("_bucket")]
    rows = df.select(seq, pos, *dims, *extra)
    points = lookup_join(rows, stats, [seq], [pos], how="inner").select(
        seq, pos, *[F.col("_bucket") for _ in extra], F.array(*z).alias("_z")
    )
    if bucket is None:
        return points.select(seq, pos, F.col("_z").alias("point"))
    ends = points.groupBy(seq, "_bucket").agg(
        F.min_by("_z", pos).alias("_first"), F.max_by("_z", pos).alias("_last")
    )
    along = W.partitionBy(seq).orderBy("_bucket")
    ends = ends.select(
        seq,
        "_bucket",
        F.lead("_first").over(along).alias("_after"),
        F.lag("_last").over(along).alias("_before"),
    )
    order = W.partitionBy(seq, "_bucket").orderBy(pos)
    linked = points.join(ends, [seq, "_bucket"]).select(
        seq,
        pos,
        "_z",
        F.coalesce(F.lead("_z").over(order), F.col("_after")).alias("_next"),
        F.coalesce(F.lag("_z").over(order), F.col("_before")).alias("_prev"),
    )
    flat = F.array_repeat(F.lit(0.0), len(dims))

    def unit(a: Column, b: Column) -> Column:
        step = F.zip_with(b, a, lambda p, q: p - q)
        length = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, v: t + v * v))
        return let(
            step,
            lambda s: let(
                length(s),
                lambda n: F.when(n > 0, F.transform(s, lambda v: v / n)).otherwise(flat),
            ),
        )

    vector = (
        F.when(F.col("_next").isNotNull(), unit(F.col("_z"), F.col("_next")))
        .when(F.col("_prev").isNotNull(), unit(F.col("_prev"), F.col("_z")))
        .otherwise(flat)
    )
    return linked.select(seq, pos, F.concat("_z", vector).alias("point"))


def kernel_canvas(
    points: DataFrame, seq: str, kernels: list[list[float]], bits_per_kernel: int = 3,
    degree: float = 0.07,
) -> DataFrame:
    """Encode each sequence: the kernels nearest to any of its points switch on their bits.

    The nearest kernels of a point are found inside its row; kernels then combine per
    sequence by a union of at most ``len(kernels)`` numbers, partially on the map side.
    """
    active = math.floor(degree * len(kernels) + 0.5)
    table = constant(
        [{"id": i, "c": c} for i, c in enumerate(kernels)], "array<struct<id:int,c:array<double>>>"
    )
    distances = F.transform(
        table,
        lambda k: F.struct(
            F.sqrt(
                F.aggregate(
                    F.zip_with("point", k["c"], lambda a, b: (a - b) * (a - b)),
                    F.lit(0.0),
                    lambda s, v: s + v,
                )
            ).alias("d"),
            k["id"].alias("id"),
        ),
    )
    nearest = F.slice(F.array_sort(distances), 1, active) if active else F.slice(distances, 1, 0)
    hits = points.select(seq, F.explode_outer(nearest).alias("_k")).select(
        seq, F.col("_k.id").alias("kernel")
    )
    lit_kernels = hits.groupBy(seq).agg(F.collect_set("kernel").alias("on"))
    all_bits = constant(
        [i for i in range(len(kernels)) for _ in range(bits_per_kernel)], "array<int>"
    )
    return lit_kernels.select(
        seq,
        let(
            F.col("on"),
            lambda on: F.transform(all_bits, lambda i: bit(F.array_contains(on, i)).cast("tinyint")),
        ).alias("bits"),
    )
