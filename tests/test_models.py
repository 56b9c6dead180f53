from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ntuple.functions.hashing import h3_constants, hyperplanes
from ntuple.operators import address, cluster, count_model, encode, network, regress, tune
from ntuple.operators.address import BitColumn
from ntuple.operators.bloom import BloomModel, HashFamily
from ntuple.operators.regress import RegressionModel

from . import brute
from .conftest import make_rows

BITS = BitColumn("bits")
N = 7


def slots_in_python(family: HashFamily, a: int) -> list[int]:
    key = [(a >> j) & 1 for j in range(N)]
    if family.mode == "murmur":
        data = b"".join(k.to_bytes(4, "little") for k in key)
        h1 = brute.murmur32(data, 0)
        h2 = brute.murmur32(data, h1)
        return [((h1 + i * h2) & 0xFFFFFFFF) % family.n_slots for i in range(family.n_hashes)]
    if family.mode == "h3":
        out = []
        for row in h3_constants(N, family.n_hashes, family.seed):
            h = 0
            for k, c in zip(key, row, strict=True):
                h ^= c if k else 0
            out.append(h % family.n_slots)
        return out
    planes = hyperplanes(N, family.seed)
    signature = bytearray((len(planes) + 7) // 8)
    for h, plane in enumerate(planes):
        if sum(k * p for k, p in zip(key, plane, strict=True)) >= 0:
            signature[h // 8] |= 1 << (h % 8)
    return [brute.murmur32(bytes(signature), i + 1) % family.n_slots for i in range(family.n_hashes)]


@pytest.mark.parametrize("mode", ["murmur", "h3", "simhash"])
def test_hash_families(spark, mode):
    family = HashFamily(mode, 100, 4, 9)
    df = spark.range(1 << N).withColumn("s", family.slots(F.col("id"), N))
    for r in df.collect():
        assert r["s"] == slots_in_python(family, r["id"])


def test_simhash_with_a_tail(spark):
    """More than 32 digits need more than 64 planes, whose bytes do not fill whole words."""
    family = HashFamily("simhash", 100, 2, 3)
    n = 33
    planes = hyperplanes(n, 3)
    assert len(planes) == 66
    values = [0, 5, 2**32 + 1, 2**33 - 1]
    df = spark.createDataFrame([(v,) for v in values], "a bigint").withColumn("s", family.slots(F.col("a"), n))
    for r in df.collect():
        key = [(r["a"] >> j) & 1 for j in range(n)]
        signature = bytearray(9)
        for h, plane in enumerate(planes):
            if sum(k * p for k, p in zip(key, plane, strict=True)) >= 0:
                signature[h // 8] |= 1 << (h % 8)
        assert r["s"] == [brute.murmur32(bytes(signature), i + 1) % 100 for i in range(2)]


def test_murmur_known_values():
    assert brute.murmur32(b"", 0) == 0
    assert brute.murmur32(b"", 1) == 0x514E28B7
    assert brute.murmur32(b"test", 0) == 0xBA6BD213


@pytest.mark.parametrize("mode", ["murmur", "h3", "simhash"])
@pytest.mark.parametrize("labels", [None, ["cold", "hot"]])
def test_bloom_votes_and_accuracy(toy, mode, labels):
    mapping = address.random_mapping(9, 3, 2, labels)
    model = BloomModel.train(toy, mapping, BITS, hashes=HashFamily(mode, 64, 3, 1))
    counts = model.as_count_model(toy, BITS)
    exact = count_model.CountModel.train(toy, mapping, BITS)
    # A counting filter never undercounts.
    joined = exact.table.join(counts.table.withColumnRenamed("cnt", "b"), ["label", "ram_id", "address"], "left")
    assert joined.where(F.coalesce("b", F.lit(0)) < F.col("cnt")).count() == 0
    assert count_model.accuracy(counts.classify(toy, BITS)).first()["accuracy"] >= 0.7


def test_bloom_ignore_zero(toy):
    mapping = address.random_mapping(9, 3, 2)
    model = BloomModel.train(toy, mapping, BITS, hashes=HashFamily("h3", 64, 2, 1), ignore_zero=True)
    counts = model.as_count_model(toy, BITS)
    assert counts.table.where("address = 0").count() == 0
    soft = model.membership(model.needed_addresses(toy, BITS))
    assert soft.where("address = 0 and soft_vote > 0").count() == 0


def test_threshold_search_matches_a_full_scan_of_its_steps(toy):
    mapping = address.random_mapping(9, 3, 2)
    model = count_model.CountModel.train(toy, mapping, BITS)
    votes = model.votes(toy, BITS)
    curve = tune.correct_at(tune.right_changes(votes, model.labels), [0, 1, 2, 3, 4, 5])
    rows = [(r["label"], r["votes"]) for r in votes.collect()]
    for b in range(1, 6):
        hit = 0
        for label, vs in rows:
            scores = [sum(1 for v in vs if v[c] >= b) for c in range(2)]
            hit += model.labels[scores.index(max(scores))] == label
        assert curve[b] == hit
    assert curve[0] == 0
    assert tune.search_threshold(votes, model.labels) >= 1


def test_tuned_pipeline_splits_large_data(spark):
    rng = random.Random(1)
    rows = []
    for i in range(10_400):
        lab = "ab"[i % 2]
        rows.append((i, lab, [rng.gauss(1.5 * (i % 2), 1) for _ in range(6)]))
    df = spark.createDataFrame(rows, "row_id bigint, label string, x array<double>").cache()
    model = tune.TunedBloom.fit(df, "x", "label", "row_id", 6, HashFamily("h3", 256, 2, 1), 4, 5, validation=0.1)
    assert sum(model.model.trainings.values()) == 10_400 - 1_040
    acc = count_model.accuracy(model.predict(df)).first()["accuracy"]
    assert acc >= 0.85


def test_candidate_accuracy_equals_retraining(spark):
    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], [rng.random() + 0.3 * (i % 2), rng.random()]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, x array<double>").cache()
    train, check = df.where("row_id < 40"), df.where("row_id >= 40")
    encoder = encode.fit_percentile(df, "x", 3)
    mapping = address.random_mapping(6, 4, 1)  # padded: a bit can sit in two tuples
    candidates = [encoder.thresholds[0][1] + d for d in (-0.1, -0.02, 0.03, 0.2)]
    found = tune.candidate_accuracy(
        train, check, encoder, mapping, ["a", "b"], "x", "label", "row_id", (0, 1), candidates
    )
    for c, t in enumerate(candidates):
        other = encoder.replaced(0, 1, t)
        model = count_model.CountModel.train(train, mapping, other.on("x"))
        hits = model.classify(check, other.on("x")).where("predicted = label").count()
        assert found[c] == hits


def test_threshold_search_never_gets_worse(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], [rng.random() + 0.4 * (i % 2), rng.random()]) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, label string, x array<double>")
    start = encode.fit_percentile(df, "x", 2)
    found, acc = tune.search_thermometer(
        df, "x", "label", "row_id", start, 2, 4, rounds=1, steps=4, early_stop=1
    )
    assert found.sizes == start.sizes and 0 <= acc <= 1


# -- regression --------------------------------------------------------------

REG = [("111000000", 0.2), ("111100000", 0.3), ("000011111", 0.7), ("000001111", 0.8)]


@pytest.fixture(scope="module")
def reg(spark):
    data = [(i, [int(b) for b in t], y) for i, (t, y) in enumerate(REG)]
    return spark.createDataFrame(data, "row_id bigint, bits array<tinyint>, y double").cache()


def test_refined_regression_within_two_decimals(reg):
    model = RegressionModel.train(reg, address.random_mapping(9, 3, 1), BITS, mean=regress.exponential_mean)
    refined = model.refine(reg, BITS, "row_id", steps=20)
    for r in refined.predict(reg, BITS, "row_id", ["y"]).collect():
        assert abs(r["prediction"] - r["y"]) < 0.005


@pytest.mark.parametrize(
    "mean,expected",
    [
        (regress.ratio_mean, 12 / 5),
        (regress.power_mean(2.0), math.sqrt((4 + 9) / 2)),
        (regress.median_mean, 2.5),
        (regress.harmonic_mean, 2 / (1 / 2 + 1 / 3)),
        (regress.harmonic_power_mean(2.0), math.sqrt(2 / (1 / 4 + 1 / 9))),
        (regress.geometric_mean, math.sqrt(6)),
        (regress.exponential_mean, math.log((1 + math.e**2 + math.e**3) / 2)),
        (regress.logistic_mean(0.5, 0.25, -1.0), 1 / (1 + math.exp(-(1.25 + 0.25 * 2 / 3 - 1)))),
    ],
)
def test_means(spark, mean, expected):
    df = spark.createDataFrame([(1, 3, 6.0), (1, 2, 6.0), (1, 0, 0.0), (2, 0, 0.0)], "k int, c bigint, s double")
    out = {r["k"]: r["m"] for r in df.groupBy("k").agg(mean(F.col("c"), F.col("s")).alias("m")).collect()}
    assert out[1] == pytest.approx(expected) and out[2] == 0.0


def test_gates_apply_to_voting_only(reg):
    mapping = address.random_mapping(9, 3, 1)
    open_ = RegressionModel.train(reg, mapping, BITS)
    gated = RegressionModel.train(reg, mapping, BITS, min_one=1, ignore_zero=True)
    assert gated.min_zero == 1 and open_.table.count() == gated.table.count()
    for r in gated.lookups(reg, BITS, "row_id").collect():
        ones = bin(r["address"]).count("1")
        assert (r["cnt"] > 0) == (1 <= ones <= 2)


# -- clustering --------------------------------------------------------------

RULE = cluster.Rule(0.3, 8.0, 3)


@pytest.fixture(scope="module")
def grouped(spark):
    rows = make_rows(45, 18, 11, ("a", "b"))
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    tuples = cluster.cluster_tuples(18, 5, RULE.limit, 4)
    expected = {}
    for lab in "ab":
        mine = [(bits, y) for _, bits, g, y in rows if g == lab]
        _, clusters = brute.leaders(mine, [tuples[str(c)] for c in range(RULE.limit)], RULE)
        for c, (cells, n) in enumerate(clusters):
            expected[(lab, c)] = (n, cells)
    return df.cache(), rows, tuples, expected


def contents(model):
    out = {}
    for r in model.table.collect():
        out.setdefault((r["label"], r["cluster"]), {})[(r["ram_id"], r["address"])] = r["cnt"]
    return out


def plain(expected):
    return {
        key: {(r, a): n for r, cell in enumerate(cells) for a, (n, _s) in cell.items()}
        for key, (_n, cells) in expected.items()
    }


def test_sequential_clusters(grouped):
    df, _, tuples, expected = grouped
    model = cluster.train_sequential(df, "bits", 18, 5, 4, "row_id", "label", "y", RULE)
    assert model.tuples == tuples
    assert model.sizes == {k: n for k, (n, _) in expected.items()}
    assert contents(model) == plain(expected)
    sums = {(r["label"], r["cluster"], r["ram_id"], r["address"]): r["sum_y"] for r in model.table.collect()}
    for (lab, c), (_n, cells) in expected.items():
        for r, cell in enumerate(cells):
            for a, (_k, s) in cell.items():
                assert sums[(lab, c, r, a)] == pytest.approx(s)


def test_rounds_of_one_row_are_the_row_by_row_rule(spark, grouped):
    df, rows, _, _ = grouped
    few = df.where("label = 'a'").orderBy("row_id").limit(6)
    ids = [r["row_id"] for r in few.collect()]
    model = None
    for i in ids:
        one = df.where(F.col("row_id") == i)
        model = cluster.train_rounds(one, "bits", 18, 5, 4, "row_id", "label", "y", RULE, 1, model)
    tuples = cluster.cluster_tuples(18, 5, RULE.limit, 4)
    mine = [(bits, y) for i, bits, _, y in rows if i in ids]
    _, clusters = brute.leaders(mine, [tuples[str(c)] for c in range(RULE.limit)], RULE)
    assert model.sizes == {("a", c): n for c, (_, n) in enumerate(clusters)}
    assert contents(model) == plain({("a", c): (n, cells) for c, (cells, n) in enumerate(clusters)})


def test_rounds_train_every_row_and_respect_the_limit(grouped):
    df, rows, _, _ = grouped
    model = cluster.train_rounds(df, "bits", 18, 5, 4, "row_id", "label", rule=RULE, first_slice=20)
    per_label = {}
    for (lab, c), n in model.sizes.items():
        per_label.setdefault(lab, []).append(n)
    assert all(len(ns) <= RULE.limit for ns in per_label.values())
    assert sum(model.sizes.values()) >= len(rows)
    out = model.classify(df, "bits")
    assert count_model.accuracy(out).first()["accuracy"] >= 0.8
    assert out.where("predicted_cluster is null").count() == 0
    scores = model.similarities(df, "bits", "row_id").collect()
    assert len(scores) == len(rows) * len(model.sizes) and all(0 <= r["score"] <= 1 for r in scores)


def test_semi_supervised_and_unsupervised(spark, grouped):
    df, rows, _, _ = grouped
    partly = df.withColumn("label", F.when(F.col("row_id") % 3 == 0, F.lit(None)).otherwise(F.col("label")))
    model = cluster.train_semi_supervised(partly, "bits", 18, 5, 4, "row_id", rule=RULE, first_slice=40)
    assert {lab for lab, _ in model.sizes} == {"a", "b"} and sum(model.sizes.values()) >= len(rows)
    free = cluster.train_rounds(df, "bits", 18, 5, 4, "row_id", rule=RULE, first_slice=40)
    found = {r["predicted_cluster"] for r in free.classify(df, "bits").collect()}
    assert found <= {0, 1, 2}
    assert free.with_rule(limit=7).rule.limit == 7


def test_clustered_regression(reg):
    model = cluster.train_rounds(
        reg, "bits", 9, 3, 1, "row_id", y="y", rule=cluster.Rule(0.2, 2.0, 10), first_slice=1
    )
    for r in model.predict(reg, "bits", "row_id", regress.exponential_mean).join(reg, "row_id").collect():
        assert math.isfinite(r["prediction"])
    near = model.predict(reg, "bits", "row_id", regress.ratio_mean).join(reg, "row_id").collect()
    assert all(abs(r["prediction"] - r["y"]) < 0.11 for r in near)


# -- networks ----------------------------------------------------------------


def test_lut_network_against_plain_python(spark):
    rng = random.Random(6)
    mappings = [address.stacked_permutations(12, 3, 6, 1), address.stacked_permutations(6, 2, 5, 2)]
    tables = [[[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)], [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)]]
    values = spark.createDataFrame(
        [(la, lu, a, v) for la, t in enumerate(tables) for lu, row in enumerate(t) for a, v in enumerate(row)],
        "layer int, lut int, addr int, value double",
    )
    net = network.LutNetwork.of(values, mappings, ["x", "y"], 2.0)
    inputs = [[rng.randrange(2) for _ in range(12)] for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(inputs)), "row_id bigint, bits array<tinyint>")
    got = {r["row_id"]: r["s"] for r in df.select("row_id", net.scores(F.col("bits")).alias("s")).collect()}
    for i, bits in enumerate(inputs):
        out = bits
        for mapping, table in zip(mappings, tables, strict=True):
            out = [int(t[brute.address(out, tup)] > 0) for tup, t in zip(mapping.of(""), table, strict=True)]
        padded = [0] + out  # five outputs, two groups: padded on the left
        assert got[i] == [sum(padded[:3]) / 2.0, sum(padded[3:]) / 2.0]
    assert network.lut_bytes(net) == -(-(48 + 20) // 8) + 4 * (18 + 10)
    # The form that leaves the parameters in their table gives the same, for rows that repeat too.
    doubled = df.union(df).withColumn("extra", F.lit(1))
    joined = network.LutTables(values, tuple(mappings), ["x", "y"], 2.0).predict(doubled, "bits")
    assert joined.columns == [*doubled.columns, "scores", "predicted"]
    found = joined.collect()
    assert len(found) == 40 and all(r["scores"] == got[r["row_id"]] for r in found)


def test_spectrum_energy_is_parseval(spark):
    rng = random.Random(7)
    row = [rng.uniform(-1, 1) for _ in range(8)]
    values = spark.createDataFrame([(0, 0, a, v) for a, v in enumerate(row)], "layer int, lut int, addr int, value double")
    energy = network.lut_spectrum(values, 3).first()["energy"]
    assert energy == pytest.approx(sum(v * v for v in row) / 8)


def test_bloom_layer_bounds_and_pruning(spark):
    rng = random.Random(8)
    mapping = address.padded_permutation(32, 5, 3)
    labels = ["a", "b", "c"]
    table = spark.createDataFrame(
        [(lab, f, s, rng.uniform(-1, 1)) for lab in labels for f in range(mapping.n_rams) for s in range(64)],
        "label string, filter int, slot int, value double",
    )
    layer = network.BloomLayer.of(table, mapping, h3_constants(5, 2, 1), 64, labels)
    df = spark.createDataFrame(
        [(i, labels[i % 3], [rng.randrange(2) for _ in range(32)]) for i in range(30)],
        "row_id bigint, label string, bits array<tinyint>",
    )
    for r in df.select(layer.logits(F.col("bits")).alias("s")).collect():
        assert all(abs(v) <= mapping.n_rams for v in r["s"])
    scores = network.filter_scores(layer, df, "bits", "label")
    keep = sorted(r["filter"] for r in network.filters_to_keep(scores, mapping.n_rams, 0.3).collect())
    assert len(keep) == mapping.n_rams - int(0.3 * mapping.n_rams)
    small = layer.pruned(keep)
    assert small.size_bytes() < layer.size_bytes() < layer.size_bytes(True)
    a = df.select(layer.responses(F.col("bits")).alias("r")).collect()
    b = df.select(small.responses(F.col("bits")).alias("r")).collect()
    assert [[r["r"][f] for f in keep] for r in a] == [r["r"] for r in b]


def test_rounds_over_patterns_are_rounds_over_rows(spark, monkeypatch):
    """Repeated rows are one pattern; arrays and joins give what rounds over single rows give."""
    rng = random.Random(5)
    kinds = [[rng.randrange(2) for _ in range(12)] for _ in range(9)]
    rows = [(i, kinds[rng.randrange(9)], "ab"[rng.randrange(2)], float(rng.randrange(50))) for i in range(90)]
    rows[3] = (*rows[3][:3], None)
    rule, tuples = cluster.Rule(0.4, 12.0, 3), cluster.cluster_tuples(12, 4, 3, 2)
    expected: dict = {}
    for lab in "ab":
        clusters: list = []
        for low, high in ((0, 20), (20, 60), (60, 90)):
            pending = [r for r in rows[low:high] if r[2] == lab]
            while pending:
                frozen = [([dict(cell) for cell in cells], n) for cells, n in clusters]
                later, opened = [], False
                for _, bits, _, y in pending:
                    scores = []
                    for c, (cells, _n) in enumerate(frozen):
                        v = [cells[r].get(brute.address(bits, t), (0, 0))[0] for r, t in enumerate(tuples[str(c)])]
                        scores.append(sum(v) / (max(v) * len(v)) if max(v) else 0.0)
                    fits = [c for c, s in enumerate(scores) if s >= min(1.0, 0.4 + frozen[c][1] / 12.0)]
                    if not fits and len(frozen) == rule.limit:
                        fits = [max(range(rule.limit), key=lambda c: (scores[c], c))]
                    if not fits and not opened:
                        opened, fits = True, [len(clusters)]
                        clusters.append(([{} for _ in tuples["0"]], 0))
                    for c in fits:
                        for r, t in enumerate(tuples[str(c)]):
                            n, total = clusters[c][0][r].get(brute.address(bits, t), (0, 0.0))
                            clusters[c][0][r][brute.address(bits, t)] = (n + 1, total + (y or 0.0))
                        clusters[c] = (clusters[c][0], clusters[c][1] + 1)
                    if not fits:
                        later.append((0, bits, lab, y))
                pending = later
        expected |= {(lab, c): cells for c, (cells, _n) in enumerate(clusters)}
    cells = {(lab, c, r, a): v for (lab, c), own in expected.items() for r, cell in enumerate(own) for a, v in cell.items()}
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    for most in (cluster.DENSE_CELLS, 1):
        monkeypatch.setattr(cluster, "DENSE_CELLS", most)
        model = cluster.train_rounds(df, "bits", 12, 4, 2, "row_id", "label", "y", rule, 20)
        got = {(r["label"], r["cluster"], r["ram_id"], r["address"]): (r["cnt"], r["sum_y"]) for r in model.table.collect()}
        assert got == cells


def test_rounds_read_their_rows_once(spark, tmp_path):
    """However many rounds there are, what the rows come from is computed once."""
    rows = make_rows(60, 18, 3, ("a", "b"))
    read = spark.sparkContext.accumulator(0)

    def bits(x):
        read.add(1)
        return x

    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    counted = df.withColumn("bits", F.udf(bits, "array<tinyint>")("bits"))
    cluster.train_rounds(counted, "bits", 18, 5, 4, "row_id", "label", rule=RULE, first_slice=10)
    assert read.value == 60


def test_sequential_groups_share_their_tasks(spark, monkeypatch):
    """Many small groups, cut by Arrow batches and by the batches of results, stay apart; no call for each group."""
    monkeypatch.setattr(cluster, "CELLS_AT_ONCE", 40)
    monkeypatch.setattr(cluster, "PATTERNS", 3)
    rows = [(i, bits, f"g{i * 7 % 23}", y) for i, bits, _, y in make_rows(400, 18, 6)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    model = cluster.train_sequential(df.repartition(3), "bits", 18, 5, 4, "row_id", "label", "y", RULE)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in model.counts._jdf.queryExecution().toString()
    expected, sizes = {}, {}
    for lab in {r[2] for r in rows}:
        mine = [(bits, y) for _, bits, g, y in rows if g == lab]
        _, clusters = brute.leaders(mine, [model.tuples[str(c)] for c in range(RULE.limit)], RULE)
        expected |= {(lab, c): (n, cells) for c, (cells, n) in enumerate(clusters)}
    assert model.sizes == {k: n for k, (n, _) in expected.items()}
    assert contents(model) == plain(expected)
    with pytest.raises(Exception, match="fewer bits"):
        cluster.train_sequential(df.withColumn("bits", F.slice("bits", 1, 9)), "bits", 18, 5, 4, "row_id", "label", "y", RULE).counts.count()


def test_sequential_trains_patterns_that_were_taken_apart_before():
    """A pattern of bits is taken apart once, however many rows have it."""
    cells = cluster.PatternCells(cluster.cluster_tuples(6, 2, 2, 1))
    pattern = b"".join(int(b).to_bytes(4, "little") for b in (1, 0, 1, 1, 0, 0))
    assert cells.of(pattern) is cells.of(pattern)
    assert [[a for _, a in own] for own in cells.of(pattern)] == [
        [brute.address((1, 0, 1, 1, 0, 0), t) for t in group] for group in cells.groups
    ]


def test_predictions_meet_each_pattern_once(spark, monkeypatch):
    """Equal rows are predicted together, whether a group's cells are one row or looked up singly."""
    rows = [(i, bits, f"g{i % 3}", y) for i, bits, _, y in make_rows(60, 18, 12)]
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows * 3)] + [(900, rows[0][1], "new", 0.0), (901, None, "g0", 0.0)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    model = cluster.train_sequential(df.where("row_id < 60"), "bits", 18, 5, 4, "row_id", "label", "y", RULE)
    tuples = [model.tuples[str(c)] for c in range(RULE.limit)]
    expected = {}
    for lab in ("g0", "g1", "g2"):
        _, clusters = brute.leaders([(b, y) for i, b, g, y in rows if g == lab and i < 60], tuples, RULE)
        for i, bits, _, _ in (r for r in rows if r[2] == lab):
            best = None
            for c, (cells, _n) in enumerate(clusters):
                v = [cells[r].get(brute.address(bits or [0] * 18, t), (0, 0.0)) for r, t in enumerate(tuples[c])]
                top, n = max(x for x, _ in v), sum(x for x, _ in v)
                score = n / (top * len(v)) if top else 0.0
                if best is None or score > best[0]:
                    best = (score, sum(s for _, s in v) / n if n else 0.0)
            expected[i] = pytest.approx(best[1] if best[0] > 0 else 0.0)
    seen = []
    votes = cluster.ClusterModel._votes
    monkeypatch.setattr(cluster.ClusterModel, "_votes", lambda m, p: seen.append(p.count()) or votes(m, p))
    for most in (cluster.GROUP_CELLS, 1):
        monkeypatch.setattr(cluster, "GROUP_CELLS", most)
        found = model.predict(df, "bits", "row_id", regress.ratio_mean, "label").collect()
        assert len(found) == len(expected) and {r["row_id"]: r["prediction"] for r in found} == expected
    assert max(seen) <= 62


def test_groups_in_step_are_groups_row_by_row():
    """Many groups trained together, long and short ones, give the sums of the rule row by row, bit for bit."""
    rng, rule = random.Random(8), cluster.Rule(0.4, 6.0, 3)
    tuples = cluster.cluster_tuples(9, 4, 3, 2)
    rows = [(f"g{g:02}", [rng.randrange(2) for _ in range(9)], rng.random()) for g in range(30) for _ in range(1 + g % 7 * 4)]
    begin = np.array([i for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]])
    length = np.diff(np.append(begin, len(rows)))
    steps = cluster.StepLeaders(rule, tuples)
    names = pa.array([rows[b][0] for b in begin])
    found = steps.of(names, begin, length, np.array([r[1] for r in rows], np.int8), np.array([r[2] for r in rows]))
    got = {
        (r["label"], r["cluster"]): (r["size"], dict(zip(zip(r["ram_id"], r["address"]), zip(r["cnt"], r["sum_y"]))))
        for batch in found for r in batch.to_pylist()
    }
    want = {}
    for lab in names.to_pylist():
        leaders = cluster.Leaders(rule, len(tuples["0"]))
        for g, bits, y in rows:
            if g == lab:
                leaders.train([[brute.address(bits, t) for t in tuples[str(c)]] for c in range(3)], y)
        for c, own in enumerate(leaders.counts):
            want[lab, c] = (leaders.sizes[c], {k: (n, leaders.sums[c][k]) for k, n in own.items()})
    assert got == want


def test_groups_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(cluster, "ROWS_AT_ONCE", 4)
    labels = list("aabbbbbbbbbcddddef")
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(labels[i : i + 3]), pa.array([[j % 2, 1, 9] for j in range(i, min(i + 3, len(labels)))], pa.list_(pa.int8())), pa.array([float(j) for j in range(i, min(i + 3, len(labels)))])],
            names=["label", "bits", "y"],
        )
        for i in range(0, len(labels), 3)
    ]
    parts = list(cluster._whole_groups([batches[0].slice(0, 0), *batches], 2))
    assert len(parts) > 1 and [x for p in parts for x in p[0].to_pylist()] == labels
    assert sum(len(set(p[0].to_pylist())) for p in parts) == len(set(labels))
    assert np.concatenate([p[1] for p in parts]).tolist() == [[j % 2, 1] for j in range(len(labels))]
    assert np.concatenate([p[2] for p in parts]).tolist() == list(range(len(labels)))


def test_rows_of_groups_are_judged_without_exploding_votes(spark, monkeypatch):
    """Rows meet the cells of their group in one sorted stream, small batches, hot groups and odd rows included."""
    rows = [(i, bits, "hot" if i % 2 else f"g{i % 5}", y) for i, bits, _, y in make_rows(300, 18, 12)]
    rows += [(900, rows[0][1], "a new one", 0.0), (901, None, "g0", 0.0), (902, [1, 0, 1], "hot", 0.0), (903, rows[0][1], None, 0.0)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string, y double")
    model = cluster.train_sequential(df.where("row_id < 300"), "bits", 18, 5, 4, "row_id", "label", "y", RULE)
    monkeypatch.setattr(cluster, "GROUP_CELLS", 1)
    one_by_one = {r["row_id"]: r["prediction"] for r in model.predict(df, "bits", "row_id", regress.ratio_mean, "label").collect()}
    monkeypatch.undo()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = model.predict(df, "bits", "row_id", regress.ratio_mean, "label")
    plan = found._jdf.queryExecution().toString()
    got = {r["row_id"]: r["prediction"] for r in found.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx(one_by_one) and set(got) == {r[0] for r in rows} - {900, 903}
    assert "Generate" not in plan.split("MapInArrow")[0]


def test_clusters_are_decided_as_arrays(spark):
    """Arrays and expressions decide alike, ties and repeated rows included; votes stay a column."""
    rows = make_rows(150, 18, 9)
    df = spark.createDataFrame([*rows, *rows[:20]], "row_id bigint, bits array<tinyint>, label string, y double")
    model = cluster.train_rounds(df, "bits", 18, 5, 4, "row_id", "label", rule=RULE, first_slice=40)
    out = model.classify(df, "bits")
    assert out.columns == [*df.columns, "votes", "predicted", "predicted_cluster"]
    by_rows = model.as_count_model().classify(df, BitColumn("bits"))
    names = F.concat_ws("::", "predicted", F.col("predicted_cluster").cast("string")).alias("predicted")
    got, want = (x.collect() for x in (out.select("row_id", "votes", names), by_rows.select("row_id", "votes", "predicted")))
    assert sorted(got) == sorted(want) and len(got) == 170
    plan = out.select("predicted")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "votes" not in plan.split("MapInArrow")[0]
    with pytest.raises(Exception, match="fewer bits"):
        model.classify(df.withColumn("bits", F.slice("bits", 1, 9)), "bits").select("predicted").collect()


def test_bleaching_of_arrays():
    rng = random.Random(4)
    votes = np.array([[[rng.choice([0, 0, 1, 2, 5]) for _ in range(4)] for _ in range(5)] for _ in range(300)])
    for m, scores in zip(votes, cluster.bleached(votes), strict=True):
        for t in [0, *sorted(set(m.flatten().tolist()) - {0})]:
            want = [(m[:, c] > t).sum() for c in range(4)]
            if not (max(want) > 1 and sorted(want)[-1] == sorted(want)[-2]):
                break
        assert scores.tolist() == want


def test_long_slices_are_read_by_many_tasks(spark, monkeypatch):
    """A slice lies in few files; its rounds are dealt by its length, and no pattern is a row for each tuple."""
    monkeypatch.setattr(cluster, "SLICE_ROWS", 10)
    tasks, learnt = [], []
    train, learn = cluster.DenseClusters.train, cluster.DenseClusters._learn
    monkeypatch.setattr(cluster.DenseClusters, "train", lambda m, p: tasks.append(p.rdd.getNumPartitions()) or train(m, p))
    monkeypatch.setattr(cluster.DenseClusters, "_learn", lambda m, p: learnt.append(p.count()) or learn(m, p))
    df = spark.createDataFrame(make_rows(200, 18, 3), "row_id bigint, bits array<tinyint>, label string, y double")
    model = cluster.train_rounds(df.coalesce(1), "bits", 18, 5, 4, "row_id", "label", rule=RULE, first_slice=20)
    assert tasks[-2:] == [8, 6]
    assert sum(learnt) <= sum(model.sizes.values()) >= 200
