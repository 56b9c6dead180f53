from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ntuple.functions.expr import pack_bits, unpack_bits
from ntuple.operators import encode, order

from . import brute


def bits_of(spark, features, column):
    df = spark.createDataFrame([(features,)], "x array<double>")
    return df.select(column.alias("b")).first()["b"]


def test_bit_codec_golden(spark):
    df = spark.createDataFrame([([1, 1, 1, 0, 0, 0, 1, 1, 1],)], "bits array<tinyint>")
    packed = df.select("bits", pack_bits(F.col("bits")).alias("p"))
    row = packed.select(F.base64("p").alias("t"), unpack_bits(F.col("p")).alias("b")).first()
    assert row["t"] == "B+OA"
    assert row["b"] == [1, 1, 1, 0, 0, 0, 1, 1, 1]


def test_fixed_and_ragged_thermometer_goldens(spark):
    x = [0.51, 0.5, 1.0]
    assert bits_of(spark, x, encode.fixed_thermometer(3).bits("x")) == [1, 1, 1, 0, 1, 1]
    assert bits_of(spark, x, encode.ragged_thermometer([2, 4, 2]).bits("x")) == [1, 1, 1, 1, 0, 0, 1, 1]


def test_threshold_goldens(spark):
    x = [999999999999.0, 10.000001, 10.0, 9.0, 9.99999999, -1.0, 0.0]
    assert bits_of(spark, x, encode.constant_threshold("x", 10.0)) == [1, 1, 1, 0, 0, 0, 0]
    x = [-1.0, 0.0, 1.0, 2.0, 2.9999999999, 3.0, 3.0000000001, 4.0, 5.0, 6.0, 7.0]
    assert bits_of(spark, x, encode.row_mean_threshold("x")) == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]


TWO = [(0, 10), (0.1, 8), (0.2, 6), (0.3, 5), (0.4, 4), (0.5, 3), (0.6, 2), (0.7, 1.5), (0.8, 1), (1, 0.5)]


@pytest.mark.parametrize(
    "fit",
    [
        encode.fit_percentile,
        encode.fit_gaussian,
        encode.fit_gaussian_clamped,
        encode.fit_exponential,
        encode.fit_logarithmic,
        encode.fit_linear,
    ],
)
def test_fitted_thermometers(spark, fit):
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in TWO], "x array<double>")
    encoder = fit(df, "x", 8)
    assert encoder.sizes == [8, 8]
    for ts in encoder.thresholds:
        assert list(ts) == sorted(ts)
    assert len(bits_of(spark, [0.5, 3.0], encoder.bits("x"))) == 16
    assert encode.Thermometer.from_table(encoder.table(spark)) == encoder


def test_order_statistics_with_a_hot_value(spark):
    rng = random.Random(3)
    values = [7.25] * 400 + [rng.gauss(0, 1) * 10 ** rng.randrange(-8, 12) for _ in range(800)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double").repartition(7)
    ranks = [0, 1, 17, 399, 600, 777, 1100, 1199]
    found = order.order_statistics(df, ["k"], "v", lambda _k, _n: ranks)[("k",)]
    ordered = sorted(values)
    assert [s.value for s in found] == [ordered[r] for r in ranks]
    assert [s.below for s in found] == [sum(v < ordered[r] for v in values) for r in ranks]


def test_global_ranks_split_ties(spark):
    values = [5.0] * 300 + [float(i % 37) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double")
    out = order.global_ranks(df, [], "v", "id", 16)
    expected = {i: r for r, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    rows = out.collect()
    assert {r["id"]: r["rank"] for r in rows} == expected
    sizes = {}
    for r in rows:
        sizes[r["rank_bin"]] = sizes.get(r["rank_bin"], 0) + 1
    assert max(sizes.values()) <= 38 and len(sizes) == 16


def test_entropy_weighted_against_row_by_row(spark):
    rng = random.Random(9)
    rows = [(i, round(rng.random(), 2), rng.choice("ab" if i % 3 else "bbc")) for i in range(203)]
    df = spark.createDataFrame([(i, [v], lab) for i, v, lab in rows], "row_id bigint, x array<double>, label string")
    found = encode.fit_entropy_weighted(df, "x", "label", "row_id", 6, n_bins=9)
    ordered = sorted((v, i, lab) for i, v, lab in rows)
    expected = brute.entropy_thresholds([v for v, _, _ in ordered], [lab for _, _, lab in ordered], 6)
    assert list(found.thresholds[0]) == expected


def test_allocate_bits():
    assert encode.allocate_bits([1.0, 1.0], 4, 2) == [2, 2]
    assert encode.allocate_bits([0.0, 0.0, 0.0], 8, 1) == [3, 3, 2]
    assert encode.allocate_bits([3.0, 1.0], 10, 1) == [7, 3]


def test_kernel_canvas_emits_bits(spark):
    rows = [(1, i, float(i), float(i) / 2) for i in range(100)] + [(2, 0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "seq bigint, pos int, x double, y double")
    for bucket, dim in ((None, 2), (F.floor(F.col("pos") / 16), 4)):
        points = encode.squashed_points(df, "seq", "pos", ["x", "y"], bucket)
        out = encode.kernel_canvas(points, "seq", encode.kernel_table(10, dim, 1), 4, 0.2).collect()
        assert len(out) == 2
        for r in out:
            assert len(r["bits"]) == 40 and set(r["bits"]) <= {0, 1} and sum(r["bits"]) >= 8


def test_direction_does_not_depend_on_the_buckets(spark):
    rng = random.Random(4)
    rows = [(s, p, rng.random(), rng.random()) for s in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "seq bigint, pos int, x double, y double")
    results = []
    for width in (3, 1000):
        points = encode.squashed_points(df, "seq", "pos", ["x", "y"], F.floor(F.col("pos") / width))
        results.append({(r["seq"], r["pos"]): [round(v, 9) for v in r["point"]] for r in points.collect()})
    assert results[0] == results[1]
    last, before = results[0][(1, 39)], results[0][(1, 38)]
    assert last[2:] == before[2:]


def test_many_keys_and_ranks(spark):
    """A key for every few rows, a rank for every value; null and negative values, a null key."""
    rows = [(i % 500 if i % 97 else None, None if i % 11 == 0 else float((i * 7919) % 601 - 300)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v double")
    found = order.order_statistics(df, ["k"], "v", lambda _k, n: list(range(n)))
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault((k,), []).append(v)
    assert {k: [s.value for s in stats] for k, stats in found.items()} == {k: sorted(v) for k, v in values.items()}
    for k, stats in found.items():
        assert [s.below for s in stats] == [sum(x < s.value for x in values[k]) for s in stats]
    assert order.order_statistics(df.where("v > 1000"), ["k"], "v", lambda _k, n: [0]) == {}


def test_ranks_shuffle_rows_once_and_split_hot_values(spark, monkeypatch):
    """A value that two thirds of the rows share is cut by the tie-break over many partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 60_000, 1, 8).select(
            "id", (F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 1000).cast("double").alias("v"), F.lit("x").alias("bin")
        )
        written, real = [], order.cut_lineage
        monkeypatch.setattr(order, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
        out = order.ranked(rows, ["k"], "v", "id", "r", "n")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning(k" not in plan and "SortMergeJoin" not in plan
        per_part = written[0].groupBy(F.shiftright("_place", order.PLACE_BITS)).count().collect()
        assert len(per_part) >= 4 and max(r["count"] for r in per_part) < 30_000
        window = Window.partitionBy("k").orderBy("v", "id")
        want = rows.withColumn("r", F.row_number().over(window) - 1).withColumn("n", F.lit(30_000))
        assert out.select("id", "k", "v", "bin", "r", "n").exceptAll(want.select("id", "k", "v", "bin", "r", "n")).count() == 0
        binned = order.rank_bins(rows.select("id", "k", "v"), ["k"], "v", "id", 150_000)
        assert binned.count() == 60_000 and binned.select("k", "bin").distinct().count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("entry", "size"), [(12, 8), (20, 16), (9, 5), (33, 32), (100, 6), (37, 5), (128, 8)])
def test_multi_resolution_cuts(entry, size):
    """A deficit is taken one bit at a time from the first tuples with room, round by round."""
    from ntuple.operators import address

    found = address.multi_resolution_sizes(entry, size)
    count = max(1, entry // size) + (entry % size > 0)
    if count == 1:
        assert found == [entry]
        return
    low, high = max(2, size // 2), max(max(2, size // 2), size * 3 // 2)
    wanted = [int(low + i / (count - 1) * (high - low) + 0.5) for i in range(count)]
    missing = sum(wanted) - entry
    while missing > 0 and max(wanted) > 2:
        for i in [i for i, w in enumerate(wanted) if w > 2][:missing]:
            wanted[i] -= 1
            missing -= 1
    for i in range(max(-missing, 0)):
        wanted[-1 - i % count] += 1
    assert found == wanted


def test_compiled_bits_are_the_bits_of_the_loop(spark, monkeypatch):
    from ntuple.operators import address

    df = spark.createDataFrame([(i, [x, None, float("nan")]) for i, x in enumerate((-1.0, 0.5, 2.0, None))], "i int, x array<double>")
    bits = address.ThresholdBits("x", ((0, 0.5), (1, 0.0), (2, 1.0), (0, 1.5), (7, 0.0)))
    compiled = df.select("i", bits.bits().alias("b"))
    assert "transform" not in compiled._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(address, "COMPILED_BITS", 0)
    looped = df.select("i", bits.bits().alias("b"))
    assert compiled.schema["b"].dataType == looped.schema["b"].dataType
    assert sorted(compiled.collect()) == sorted(looped.collect())
