from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ntuple.operators import address, count_model, decide, inspect
from ntuple.operators.address import BitColumn
from ntuple.operators.count_model import CountModel, Options, accuracy, check_entry_size

from . import brute
from .conftest import make_rows

BITS = BitColumn("bits")


def table_of(model):
    return {tuple(r) for r in model.table.select("label", "ram_id", "address", "cnt").collect()}


@pytest.fixture(scope="module")
def noisy(spark):
    rows = make_rows(50, 24, 5)
    df = spark.createDataFrame([r[:3] for r in rows], "row_id bigint, bits array<tinyint>, label string")
    return rows, df.cache()


def test_toy_accuracy(toy):
    for labels in (None, ["cold", "hot"]):
        model = CountModel.train(toy, address.random_mapping(9, 3, 1, labels), BITS)
        assert accuracy(model.classify(toy, BITS)).first()["accuracy"] == 1.0


@pytest.mark.parametrize("shared", [True, False])
@pytest.mark.parametrize("rule", ["bleach", "confidence", "soft", "weighted", "best"])
def test_rules_against_row_by_row(noisy, shared, rule):
    rows, df = noisy
    mapping = address.random_mapping(24, 5, 3, None if shared else ["a", "b", "c"])
    n = mapping.n_rams
    weights = {lab: [((r + i) % 4) / 4 for r in range(n)] for i, lab in enumerate("abc")}
    table = [[weights[lab][r] for lab in "abc"] for r in range(n)]
    spark_rule = {
        "bleach": decide.bleaching,
        "confidence": lambda v, k: decide.bleaching(v, k, 2),
        "soft": lambda v, k: decide.bleaching(v, k, score=decide.excess_above),
        "weighted": lambda v, k: decide.bleaching(v, k, score=decide.weight_above(table)),
        "best": decide.best_margin,
    }[rule]
    model = CountModel.train(df, mapping, BITS, options=Options(rule=spark_rule))
    plain = brute.train([(b, lab) for _, b, lab, _ in rows], mapping.of)
    expected = {}
    for i, bits, _, _ in rows:
        vs = brute.votes(plain, mapping.of, bits)
        expected[i] = {
            "bleach": lambda v: brute.bleach(v),
            "confidence": lambda v: brute.bleach(v, 2),
            "soft": lambda v: brute.bleach(v, soft=True),
            "weighted": lambda v: brute.bleach(v, weights=weights),
            "best": brute.best_scan,
        }[rule](vs)
    dense = {r["row_id"]: dict(zip("abc", r["scores"], strict=True)) for r in model.rank(df, BITS).collect()}
    assert dense == expected
    joined = model.votes_by_join(df, BITS, broadcast=False).withColumn(
        "scores", model.scores(F.col("votes"))
    )
    assert {r["row_id"]: dict(zip("abc", r["scores"], strict=True)) for r in joined.collect()} == expected
    found = {r["row_id"]: r["predicted"] for r in model.classify(df, BITS).collect()}
    assert found == {i: brute.winner(s) for i, s in expected.items()}


def test_dense_and_join_agree_with_hooks(noisy):
    _, df = noisy
    for shared in (True, False):
        mapping = address.random_mapping(24, 4, 3, None if shared else ["a", "b", "c"])
        options = Options(ignore_zero=True, balanced=True, attention=True, cross_class=True, negative_alpha=0.3)
        model = CountModel.train(df, mapping, BITS, options=options)
        a = {r["row_id"]: r["scores"] for r in model.rank(df, BITS).collect()}
        joined = model.votes_by_join(df, BITS, broadcast=False)
        b = {r["row_id"]: r["s"] for r in joined.select("row_id", model.scores(F.col("votes")).alias("s")).collect()}
        assert a == b


def test_train_then_untrain_is_empty(toy):
    model = CountModel.train(toy, address.random_mapping(9, 3, 1), BITS)
    empty = model.remove(toy, BITS)
    assert table_of(empty) == set() and set(empty.trainings.values()) == {0}
    kept = model.remove(toy, BITS, keep_zero=True)
    assert {r[3] for r in table_of(kept)} == {0}
    stranger = toy.withColumn("label", F.lit("other"))
    assert table_of(model.remove(stranger, BITS)) == table_of(model)


def test_merge_equals_training_on_the_union(noisy):
    _, df = noisy
    mapping = address.random_mapping(24, 5, 3)
    odd = F.col("row_id") % 2 == 1
    parts = CountModel.train(df.where(odd), mapping, BITS).add(df.where(~odd), BITS)
    whole = CountModel.train(df.repartition(5), mapping, BITS)
    assert table_of(parts) == table_of(whole) and parts.trainings == whole.trainings


def test_neutral_hooks_change_nothing(toy):
    mapping = address.random_mapping(9, 3, 1)
    base = CountModel.train(toy, mapping, BITS, background=mapping)
    plain = {r["row_id"]: r["scores"] for r in base.rank(toy, BITS).collect()}
    ones = {lab: [1.0] * mapping.n_rams for lab in base.labels}
    for options in (Options(negative_alpha=0.0), Options(weights=ones)):
        model = CountModel.train(toy, mapping, BITS, options=options)
        assert {r["row_id"]: r["scores"] for r in model.rank(toy, BITS).collect()} == plain
    quiet = base.with_options(background_beta=0.0)
    assert {r["row_id"]: r["scores"] for r in quiet.rank(toy, BITS).collect()} == plain


def cells(df):
    return {tuple(r[c] for c in df.columns if c != "cnt"): r["cnt"] for r in df.collect()}


@pytest.mark.parametrize("dense", [True, False])
def test_background_takes_part_in_the_normal_calls(toy, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(count_model, "DENSE_CELLS", 0)
    mapping = address.random_mapping(9, 3, 1)
    some, rest = toy.where("row_id < 6"), toy.where("row_id >= 6")
    model = CountModel.train(some, mapping, BITS, options=Options(background_beta=2.0), background=mapping)
    seen = {k[:2] for k in cells(model.background)}
    plain = {r["row_id"]: r["scores"] for r in model.with_options(background_beta=None).rank(toy, BITS).collect()}
    for r in model.rank(toy, BITS).collect():
        hits = sum((i, brute.address(r["bits"], t)) in seen for i, t in enumerate(mapping.of("")))
        assert r["scores"] == [int(s - 2.0 * hits) for s in plain[r["row_id"]]] and r["background"] == hits
    whole = CountModel.train(toy, mapping, BITS, background=mapping)
    added = model.add(rest, BITS)
    assert cells(added.background) == cells(whole.background) and cells(added.table) == cells(whole.table)
    assert cells(added.remove(rest, BITS).background) == cells(model.background)


def test_both_scoring_paths_give_the_same_rows(toy, monkeypatch):
    """All columns, one row for each input row, ids that repeat included."""
    mapping = address.random_mapping(9, 3, 1)
    doubled = toy.union(toy).withColumn("row_id", F.lit(7)).withColumn("extra", F.lit("x"))
    for chosen in (mapping, address.random_mapping(9, 3, 1, ["cold", "hot"])):
        model = CountModel.train(toy, chosen, BITS)
        frames = []
        for cells_ in (count_model.DENSE_CELLS, 0):
            monkeypatch.setattr(count_model, "DENSE_CELLS", cells_)
            frames.append(model.classify(doubled, BITS))
        monkeypatch.undo()
        assert frames[0].columns == frames[1].columns
        assert sorted(map(str, frames[0].collect())) == sorted(map(str, frames[1].collect())) and frames[1].count() == 18


@pytest.mark.parametrize("dense", [True, False])
def test_counts_beyond_32_bits(toy, monkeypatch, dense):
    if not dense:
        monkeypatch.setattr(count_model, "DENSE_CELLS", 0)
    model = CountModel.train(toy, address.random_mapping(9, 3, 1), BITS)
    large = replace(model, table=model.table.withColumn("cnt", F.col("cnt") * F.lit(1 << 33)))
    small = {r["row_id"]: (r["predicted"], r["votes"]) for r in model.classify(toy, BITS).collect()}
    for r in large.classify(toy, BITS).collect():
        assert r["votes"] == [[v << 33 for v in row] for row in small[r["row_id"]][1]]
        assert r["predicted"] == r["label"]


def test_new_labels_are_trained_or_refused(toy):
    maker = lambda labels: address.random_mapping(9, 3, 1, labels)
    cold = toy.where("label = 'cold'")
    grown = CountModel.train(cold, maker, BITS).add(toy.where("label = 'hot'"), BITS)
    assert grown.labels == ["cold", "hot"]
    assert accuracy(grown.classify(toy, BITS)).first()["accuracy"] == 1.0
    assert cells(grown.table) == cells(CountModel.train(toy, maker, BITS).table)
    with pytest.raises(ValueError):
        CountModel.train(cold, maker(["cold"]), BITS).add(toy, BITS)
    assert accuracy(CountModel.train(cold, address.random_mapping(9, 3, 1), BITS).add(toy, BITS).classify(toy, BITS)).first()["n"] == 9


def test_short_rows_are_refused(spark, toy):
    model = CountModel.train(toy, address.random_mapping(9, 3, 1), BITS)
    short = spark.createDataFrame([(0, [1], "cold")], "row_id bigint, bits array<tinyint>, label string")
    with pytest.raises(Exception, match="fewer bits"):
        model.classify(short, BITS).collect()


def test_a_reset_model_learns_anew(toy):
    mapping = address.random_mapping(9, 3, 1)
    model = CountModel.train(toy, mapping, BITS, options=Options(balanced=True), background=mapping)
    empty = model.reset()
    assert {tuple(r["scores"]) for r in empty.rank(toy, BITS).collect()} == {(0, 0)}
    again = empty.add(toy, BITS)
    assert cells(again.table) == cells(model.table) and cells(again.background) == cells(model.background)
    assert again.trainings == model.trainings


def test_winner_rules(spark):
    df = spark.createDataFrame(
        [([0, 0, 0],), ([2, 2, 1],), ([-1, -2, -3],), ([0, 3, 3],), ([-1, 0, -2],)], "s array<int>"
    )
    names = ["a", "b", "c"]
    out = df.select(
        decide.winner(F.col("s"), names).alias("w"),
        decide.first_winner(F.col("s"), names).alias("f"),
        decide.confidence(F.col("s")).alias("c"),
    ).collect()
    assert [r["w"] for r in out] == ["c", "b", "", "c", "b"]
    assert [r["f"] for r in out] == ["a", "a", "a", "b", "b"]
    assert [r["c"] for r in out] == [None, 0.5, None, 1.0, None]


def test_mental_image_golden(spark):
    # Rows and the counts they must give.
    data = [("111110000", "cold"), ("111100000", "cold"), ("000011111", "hot"), ("000001111", "hot")]
    df = spark.createDataFrame(
        [(i, [int(b) for b in t], lab) for i, (t, lab) in enumerate(data)],
        "row_id bigint, bits array<tinyint>, label string",
    )
    for mapping in (address.random_mapping(9, 3, 4), address.random_mapping(9, 3, 4, ["cold", "hot"])):
        model = CountModel.train(df, mapping, BITS)
        image: dict = {"cold": {}, "hot": {}}
        for r in inspect.mental_images(model).collect():
            image[r["label"]][r["bit_index"]] = r["intensity"]
        assert [image["cold"][i] for i in range(9)] == [2, 2, 2, 2, 1, 0, 0, 0, 0]
        assert [image["hot"][i] for i in range(9)] == [0, 0, 0, 0, 1, 2, 2, 2, 2]


def test_explicit_mapping_round_trip(spark):
    # A mapping given tuple by tuple.
    tuples = {
        "cold": [[0, 8], [1, 8], [2, 7], [3, 6], [4, 5]],
        "hot": [[8, 7], [6, 5], [4, 3], [2, 1], [0, 3]],
    }
    mapping = address.explicit_mapping(9, tuples)
    assert address.Mapping.from_table(mapping.table(spark), 9) == mapping
    with pytest.raises(ValueError):
        address.explicit_mapping(5, tuples)


def test_wide_tuples(spark):
    rows = [(i, [(i * 7 + j * (3 if i % 2 else 5)) % 2 for j in range(720)], "AB"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id bigint, bits array<tinyint>, label string")
    model = CountModel.train(df, address.random_mapping(720, 72, 1), BITS)
    assert model.mapping.is_wide and not model.is_dense()
    out = model.classify(df, BITS)
    assert accuracy(out).first()["accuracy"] == 1.0


def test_mapping_shapes():
    padded = address.random_mapping(10, 4, 1)
    assert padded.n_rams == 3 and all(0 <= i < 10 for t in padded.of("x") for i in t)
    assert address.random_mapping(10, 4, 1, complete=False).n_rams == 2
    for size, n in ((8, 128), (5, 37), (6, 100)):
        sizes = address.multi_resolution_sizes(n, size)
        assert sum(sizes) == n and min(sizes) >= 2
    local = address.local_2d_mapping(6, 8, 1, 3, 4, 4, 1, stride=1, rams_per_window=2)
    assert local.n_rams == 4 * 5 * 2
    stacked = address.stacked_permutations(12, 3, 6, 1)
    assert sorted(i for t in stacked.of("")[:4] for i in t) == list(range(12))


def test_entry_size_check(toy):
    check_entry_size(toy, "bits", 9)
    with pytest.raises(ValueError):
        check_entry_size(toy, "bits", 8)


def test_weights_stay_in_the_unit_interval(toy):
    model = CountModel.train(toy, address.random_mapping(9, 3, 1), BITS)
    for metric in ("entropy", "information_gain", "purity"):
        table = inspect.ram_weights(model, toy, BITS, metric)
        weights = inspect.weights_from_table(table)
        flat = [w for ws in weights.values() for w in ws]
        assert len(flat) == 6 and all(-1e-9 <= w <= 1 + 1e-9 for w in flat)
        pruned = inspect.weights_from_table(inspect.prune_weights(table, 0.9))
        assert all(w == 0 or w >= 0.9 for ws in pruned.values() for w in ws)
        tuned = model.with_options(weights=weights)
        assert tuned.classify(toy, BITS).count() == 9


def test_base_three_digits(spark):
    df = spark.createDataFrame(
        [(0, [0, 1, 2, 2], "a"), (1, [2, 1, 0, 0], "b")], "row_id bigint, bits array<tinyint>, label string"
    )
    mapping = address.ordered_mapping(4, 2, base=3)
    found = address.tuple_rows(df, mapping, BITS, ["row_id"]).collect()
    assert {(r[0], r[1], r[2]) for r in found} == {(0, 0, 3), (0, 1, 8), (1, 0, 5), (1, 1, 0)}
    model = CountModel.train(df, mapping, BITS)
    assert accuracy(model.classify(df, BITS)).first()["accuracy"] == 1.0
    image = {(r["label"], r["bit_index"]): r["intensity"] for r in inspect.mental_images(model).collect()}
    assert image[("a", 1)] == 1 and image[("b", 2)] == 0


def test_synthesized_rows_follow_the_image(spark):
    image = spark.createDataFrame(
        list(enumerate([2, 2, 2, 2, 1, 0, 0, 0, 0])), "bit_index int, intensity bigint"
    )
    rows = [r["bits"] for r in inspect.synthesize(image, 100, 3).collect()]
    assert all(b[:4] == [1, 1, 1, 1] and b[5:] == [0, 0, 0, 0] for b in rows)
    assert {b[4] for b in rows} == {0, 1}
