"""Decision rules over the votes of one row.

``votes`` is ``array<array<bigint>>``: tuple first, then label in byte-wise label order.  All
rules are array expressions on that column: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import bit, constant, let, truncate

Rule = Callable[[Column, int], Column]
"""Votes and number of labels in, ``array<bigint>`` of scores out (the pluggable part)."""


def _zero() -> Column:
    return F.lit(0).cast("bigint")


# -- vote re-weighting (applied in this order) -------------------------------


def balanced_votes(votes: Column, trainings: list[int]) -> Column:
    """Scale a label's votes by its share of the training rows."""
    total = sum(trainings)
    share = constant([t / total if total else 0.0 for t in trainings], "array<double>")
    return _each(votes, lambda v, c, _r: truncate(v * F.get(share, c)))


def scaled_votes(votes: Column, factors: list[list[float]], schema: str = "double") -> Column:
    """Multiply by a factor per tuple and label (tuple sizes or learned weights)."""
    table = constant(factors, f"array<array<{schema}>>")
    return _each(votes, lambda v, c, r: truncate(v * F.get(F.get(table, r), c)))


def attention_votes(votes: Column, n_labels: int) -> Column:
    """Damp tuples whose vote is far from the mean vote of their label."""

    def summary(m: Column) -> Column:
        def step(c: Column) -> Callable:
            return lambda a, r: F.struct(
                (a["s"] + F.get(r, c)).alias("s"),
                F.greatest(a["x"], F.get(r, c).cast("double")).alias("x"),
            )

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"))
        return _per_label(n_labels, m, start, step)

    def damp(m: Column, stats: Column) -> Column:
        n = F.size(m)

        def one(v: Column, c: Column, _r: Column) -> Column:
            stat = F.get(stats, c)
            return truncate(
                v * (F.lit(1.0) - F.abs(v - stat["s"] / n) / (stat["x"] + F.lit(1e-9)))
            )

        return _each(m, one)

    return let(votes, lambda m: let(summary(m), lambda stats: damp(m, stats)))


def cross_class_votes(votes: Column, n_labels: int) -> Column:
    """Votes of a tuple relative to what all labels get from it."""

    def row(r: Column) -> Column:
        return let(
            F.aggregate(r, _zero(), lambda s, v: s + v),
            lambda total: F.transform(
                r,
                lambda v: F.when(total > 0, truncate(v * n_labels / (total + 1))).otherwise(v),
            ),
        )

    return F.transform(votes, row)


def _each(votes: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """Map ``body(vote, label position, tuple position)`` over the vote table."""
    return F.transform(
        votes, lambda row, r: F.transform(row, lambda v, c: body(v, c, r).cast("bigint"))
    )


# -- scores -----------------------------------------------------------------


def _per_label(
    n_labels: int, m: Column, zero: Column, step: Callable[[Column], Callable]
) -> Column:
    """Fold the tuples once per label; ``step(c)`` is the fold for label position ``c``."""
    places = constant(list(range(n_labels)), "array<int>")
    return F.transform(places, lambda c: F.aggregate(m, zero, step(c)))


def hits_above(m: Column, t: Column, n_labels: int) -> Column:
    """Per label: tuples whose vote exceeds ``t``."""

    def step(c: Column) -> Callable:
        return lambda s, r: s + bit(F.get(r, c) > t)

    return _per_label(n_labels, m, _zero(), step)


def excess_above(m: Column, t: Column, n_labels: int) -> Column:
    """Per label: sum of what votes exceed ``t`` by."""

    def step(c: Column) -> Callable:
        return lambda s, r: s + F.greatest(F.get(r, c) - t, F.lit(0))

    return _per_label(n_labels, m, _zero(), step)


def weight_above(weights: list[list[float]]) -> Callable[[Column, Column, int], Column]:
    """Per label: total weight (tuple, label) of the tuples above ``t``, truncated."""
    table = constant(weights, "array<array<double>>")

    def score(m: Column, t: Column, n_labels: int) -> Column:
        weighted = F.zip_with(m, table, lambda r, w: F.struct(r.alias("r"), w.alias("w")))

        def step(c: Column) -> Callable:
            return lambda s, e: s + F.when(
                F.get(e["r"], c) > t, F.get(e["w"], c)
            ).otherwise(F.lit(0.0))

        return F.transform(_per_label(n_labels, weighted, F.lit(0.0), step), truncate)

    return score


def _thresholds(m: Column) -> Column:
    """Distinct positive votes of the row, ascending."""
    distinct = F.array_distinct(F.flatten(m))
    return F.sort_array(F.array_except(distinct, F.array(_zero())))


def is_ambiguous(scores: Column, confidence: int = 1) -> Column:
    """A label after the first best one comes closer than ``confidence``, and the best is > 1."""
    if confidence == 1:  # a tie at the top
        ordered = F.sort_array(scores, asc=False)
        return let(
            ordered,
            lambda o: (F.get(o, F.lit(0)) > 1)
            & F.coalesce(F.get(o, F.lit(0)) == F.get(o, F.lit(1)), F.lit(False)),
        )
    state = F.aggregate(
        scores,
        F.struct(_zero().alias("best"), F.lit(False).alias("close")),
        lambda a, s: F.when(
            s > a["best"], F.struct(s.alias("best"), F.lit(False).alias("close"))
        ).otherwise(
            F.struct(
                a["best"].alias("best"),
                (a["close"] | ((a["best"] - s) < confidence)).alias("close"),
            )
        ),
        lambda a: a["close"] & (a["best"] > 1),
    )
    return state


def bleaching(
    votes: Column, n_labels: int, confidence: int = 1, activated: bool = True, score=hits_above
) -> Column:
    """Raise the vote threshold through the distinct votes of the row until one label leads.

    ``score`` is :func:`hits_above`, :func:`excess_above` (soft) or :func:`weight_above`.
    """

    def state(m: Column, t: Column) -> Column:
        return let(
            score(m, t, n_labels),
            lambda s: F.struct((~is_ambiguous(s, confidence)).alias("done"), s.alias("s")),
        )

    def run(m: Column) -> Column:
        if not activated:
            return score(m, F.lit(0), n_labels)
        return let(
            state(m, F.lit(0)),
            lambda first: F.when(first["done"], first["s"]).otherwise(
                F.aggregate(
                    _thresholds(m),
                    first,
                    lambda a, t: F.when(a["done"], a).otherwise(state(m, t)),
                    lambda a: a["s"],
                )
            ),
        )

    return let(votes, run)


def best_margin(votes: Column, n_labels: int, mode: str = "scan") -> Column:
    """Scores at the threshold with the widest lead.

    ``scan`` measures the lead as the original label scan does: a label's lead over the best
    label before it, so a winner that sorts first gets none.  ``margin`` uses best minus
    second best.  Scores are all zero when no threshold qualifies.
    """
    zero = F.array_repeat(_zero(), n_labels)

    def scan(s: Column) -> Column:
        """The largest gain over the best label before, none where the top is reached twice."""
        before = F.transform(s, lambda _, j: F.coalesce(F.array_max(F.slice(s, F.lit(1), j)), _zero()))
        gains = F.zip_with(s, before, lambda v, b: F.when(b > 0, F.greatest(v - b, _zero())).otherwise(_zero()))
        top = F.array_max(s)
        return F.struct(
            F.array_max(gains).alias("lead"),
            ((top > 0) & (F.size(F.array_remove(s, top)) < n_labels - 1)).alias("tie"),
        )

    def margin(s: Column) -> Column:
        ordered = F.sort_array(s, asc=False)
        lead = F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0))
        return F.struct(lead.alias("lead"), F.lit(False).alias("tie"))

    measure = scan if mode == "scan" else margin

    def step(m: Column, a: Column, t: Column) -> Column:
        """A threshold counts if it leads by more than all before it."""
        return let(
            hits_above(m, t, n_labels),
            lambda s: let(
                measure(s),
                lambda q: F.struct(
                    F.greatest(q["lead"], a["lead"]).alias("lead"),
                    F.when((q["lead"] > a["lead"]) & ~q["tie"], s).otherwise(a["s"]).alias("s"),
                ),
            ),
        )

    return let(
        votes,
        lambda m: F.aggregate(
            F.concat(F.array(_zero()), _thresholds(m)),
            F.struct(_zero().alias("lead"), zero.alias("s")),
            lambda a, t: step(m, a, t),
            lambda a: a["s"],
        ),
    )


def fixed_threshold(votes: Column, n_labels: int, b: int) -> Column:
    """Per label: tuples whose vote is at least ``b``."""
    return let(votes, lambda m: hits_above(m, F.lit(b - 1), n_labels))


@dataclass(frozen=True)
class NamedRule:
    """A rule by name and parameters: it can be stored with a model and compared."""

    name: str
    parameters: tuple[tuple[str, object], ...] = ()

    def __call__(self, votes: Column, n_labels: int) -> Column:
        if self.name not in RULES:
            raise ValueError(f"unknown decision rule {self.name}")
        return RULES[self.name](votes, n_labels, **dict(self.parameters))


RULES: dict[str, Callable] = {
    "bleaching": bleaching,
    "best_margin": best_margin,
    "fixed_threshold": fixed_threshold,
}


def rule_named(name: str, **parameters) -> NamedRule:
    if name not in RULES:
        raise ValueError(f"unknown decision rule {name}")
    return NamedRule(name, tuple(sorted(parameters.items())))


def name_of(rule: Rule) -> tuple[str, dict] | None:
    """Name and parameters of a rule; None for one that is code of its own."""
    if isinstance(rule, NamedRule):
        return rule.name, dict(rule.parameters)
    return next(((name, {}) for name, known in RULES.items() if known is rule), None)


def similarity(votes: Column, n_labels: int) -> Column:
    """Per label: sum of votes over (largest vote x tuples), 0 when nothing was hit."""

    def step(c: Column) -> Callable:
        return lambda a, r: F.struct(
            (a["s"] + F.get(r, c)).alias("s"), F.greatest(a["x"], F.get(r, c)).alias("x")
        )

    start = F.struct(_zero().alias("s"), _zero().alias("x"))
    return let(
        votes,
        lambda m: F.transform(
            _per_label(n_labels, m, start, step),
            lambda a: F.when(a["x"] > 0, a["s"] / (a["x"] * F.size(m))).otherwise(F.lit(0.0)),
        ),
    )


# -- score adjustment -------------------------------------------------------


def subtract_background(scores: Column, hits: Column, beta: float) -> Column:
    """Take ``beta`` times the tuples hit in the shared background model off every score."""
    return F.transform(scores, lambda s: truncate(s - F.lit(beta) * hits))


def negative_evidence(scores: Column, alpha: float, mode: str = "uniform") -> Column:
    """Penalise a label by the scores of the others."""

    def adjust(all_: Column) -> Column:
        total = F.aggregate(all_, _zero(), lambda s, v: s + v)

        def uniform(v: Column, _i: Column) -> Column:
            return truncate(v - F.lit(alpha) * (total - v))

        def competitor(v: Column, i: Column) -> Column:
            others = F.transform(all_, lambda o, j: F.when(j == i, F.lit(0)).otherwise(o))
            return truncate(v - F.lit(alpha) * F.greatest(F.array_max(others), F.lit(0)))

        def normalized(v: Column, _i: Column) -> Column:
            return truncate(v * F.lit(1000.0) / (F.lit(1.0) + F.lit(alpha) * (total - v)))

        chosen = {"uniform": uniform, "max_competitor": competitor, "normalized": normalized}
        return F.transform(all_, chosen[mode])

    return let(scores, adjust)


# -- winner -----------------------------------------------------------------


def winner(scores: Column, labels: list[str]) -> Column:
    """Best score; the last label wins ties, and no label wins with a negative best."""
    names = constant(labels, "array<string>")
    return let(
        scores,
        lambda s: F.when(F.array_max(s) < 0, F.lit("")).otherwise(
            F.element_at(
                names,
                (F.lit(len(labels) + 1) - F.array_position(F.reverse(s), F.array_max(s))).cast("int"),
            )
        ),
    )


def first_winner(scores: Column, labels: list[str]) -> Column:
    """Best score; the first label wins ties."""
    names = constant(labels, "array<string>")
    return let(
        scores,
        lambda s: F.element_at(names, F.array_position(s, F.array_max(s)).cast("int")),
    )


def confidence(scores: Column) -> Column:
    """(best - best score below it) / best; null when nothing scored."""
    return let(
        scores,
        lambda s: let(
            F.greatest(F.array_max(s), F.lit(0)),
            lambda best: F.when(
                best > 0,
                (
                    best
                    - F.coalesce(
                        F.array_max(F.filter(s, lambda v: (v < best) & (v >= 0))), F.lit(0)
                    )
                )
                / best,
            ),
        ),
    )


def score_map(scores: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(constant(labels, "array<string>"), scores)
