"""Counting classifier queries: training, votes, decision rules, weights, inspection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import constant
from ..operators import address, count_model, decide, encode, inspect
from ..operators.count_model import CountModel, Options
from . import sql, tables
from .encoding import LINE_BITS, VECTOR_BITS
from .registry import query

SEED = 7
VECTOR_MAPPING = address.random_mapping(128, 8, SEED)
LINE_MAPPING = address.random_mapping(32, 8, SEED)

VECTOR_PREFIX = sql.VECTORS + "," + sql.VECTOR_BITS + "," + sql.shared_mapping(128, 8, SEED)
LABEL_PREFIX = sql.VECTORS + "," + sql.VECTOR_BITS + "," + sql.label_mapping(128, 8, SEED, "SELECT DISTINCT label FROM xs")
LINE_PREFIX = sql.LINES + "," + sql.bits_from(sql.LINE_THRESHOLDS) + "," + sql.shared_mapping(32, 8, SEED)
MODEL_ROWS = "SELECT label, ram AS ram_id, a AS address, c AS cnt FROM model"


def per_label(size: int = 8) -> Callable[[list[str]], address.Mapping]:
    return lambda labels: address.random_mapping(128, size, SEED, labels)


def vector_model(spark: SparkSession, sf_dir: str, mapping=VECTOR_MAPPING, **options) -> tuple[CountModel, DataFrame]:
    rows = tables.vectors(spark, sf_dir)
    return CountModel.train(rows, mapping, VECTOR_BITS.on("x"), options=Options(**options)), rows


def candidate_scores(ranked: DataFrame, labels: list[str]) -> DataFrame:
    """Scores as rows ``(row_id, candidate, score)``."""
    names = constant(labels, "array<string>")
    return ranked.select("row_id", F.posexplode("scores").alias("_c", "score")).select(
        "row_id", F.get(names, F.col("_c")).alias("candidate"), F.col("score").cast("bigint").alias("score")
    )


def ranked_vectors(spark: SparkSession, sf_dir: str, mapping=VECTOR_MAPPING, **options) -> DataFrame:
    model, rows = vector_model(spark, sf_dir, mapping, **options)
    return candidate_scores(model.rank(rows, VECTOR_BITS.on("x")), model.labels)


# -- training ----------------------------------------------------------------


@query("train_counts", sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, final=MODEL_ROWS))
def train_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_model.count_addresses(tables.vectors(spark, sf_dir), VECTOR_MAPPING, VECTOR_BITS.on("x"))


@query("train_counts_per_label", sql.chain(LABEL_PREFIX, sql.LABEL_CLASSIFIER, final=MODEL_ROWS))
def train_counts_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_model(spark, sf_dir, per_label())[0].table


@query("train_counts_lineitem", sql.chain(LINE_PREFIX, sql.ADDRESSES, sql.MODEL, final=MODEL_ROWS))
def train_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_model.count_addresses(tables.line_items(spark, sf_dir), LINE_MAPPING, LINE_BITS.on("x"))


@query(
    "class_counts",
    "SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_model.class_counts(tables.line_items(spark, sf_dir))
    return spark.createDataFrame(list(found.items()), "label string, n bigint")


@query(
    "untrain_rows",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES,
        "gone AS (SELECT row_id FROM xs WHERE f = 0 AND v > 0)",
        "model AS (SELECT label, ram, a, count(*) AS c FROM addr WHERE row_id NOT IN (SELECT row_id FROM gone) GROUP BY label, ram, a)",
        final=MODEL_ROWS,
    ),
)
def untrain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    return model.remove(rows.where(F.get("x", F.lit(0)) > 0), VECTOR_BITS.on("x")).table


@query(
    "untrain_rows_keep_zero",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES,
        "gone AS (SELECT row_id FROM xs WHERE f = 0 AND v > 0)",
        "model AS (SELECT label, ram, a, count(*) FILTER (row_id NOT IN (SELECT row_id FROM gone)) AS c FROM addr GROUP BY label, ram, a)",
        final=MODEL_ROWS,
    ),
)
def untrain_rows_keep_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    return model.remove(rows.where(F.get("x", F.lit(0)) > 0), VECTOR_BITS.on("x"), keep_zero=True).table


@query("train_incrementally", sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, final=MODEL_ROWS))
def train_incrementally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    positive = F.get("x", F.lit(0)) > 0
    bits = VECTOR_BITS.on("x")
    return CountModel.train(rows.where(positive), VECTOR_MAPPING, bits).add(rows.where(~positive), bits).table


@query("reset_model", sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, final=MODEL_ROWS))
def reset_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that forgot everything and is trained again equals a fresh one."""
    model, rows = vector_model(spark, sf_dir)
    return model.reset().add(rows, VECTOR_BITS.on("x")).table


@query(
    "train_background",
    sql.chain(VECTOR_PREFIX, sql.ADDRESSES, final="SELECT ram AS ram_id, a AS address, count(*) AS cnt FROM addr GROUP BY ram, a"),
)
def train_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    return CountModel.train(rows, VECTOR_MAPPING, VECTOR_BITS.on("x"), background=VECTOR_MAPPING).background


# -- classification ----------------------------------------------------------


@query("classify_bleaching", sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(), sql.winner(), final=sql.PREDICTED))
def classify_bleaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    return model.classify(rows, VECTOR_BITS.on("x")).select("row_id", "label", "predicted")


@query("classify_bleaching_join", sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(), sql.winner(), final=sql.PREDICTED))
def classify_bleaching_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the salted shuffle join that large models use."""
    model, rows = vector_model(spark, sf_dir)
    voted = model.votes_by_join(rows, VECTOR_BITS.on("x"), broadcast=False)
    return voted.select(
        "row_id", "label", decide.winner(model.scores(F.col("votes")), model.labels).alias("predicted")
    )


@query("classify_per_label_mapping", sql.chain(LABEL_PREFIX, sql.LABEL_CLASSIFIER, sql.bleaching(), sql.winner(), final=sql.PREDICTED))
def classify_per_label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir, per_label())
    return model.classify(rows, VECTOR_BITS.on("x")).select("row_id", "label", "predicted")


@query("classify_per_label_join", sql.chain(LABEL_PREFIX, sql.LABEL_CLASSIFIER, sql.bleaching(), sql.winner(), final="SELECT row_id, predicted FROM won"))
def classify_per_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir, per_label())
    voted = model.votes_by_join(rows, VECTOR_BITS.on("x"))
    return voted.select("row_id", decide.winner(model.scores(F.col("votes")), model.labels).alias("predicted"))


@query(
    "classify_wide_tuples",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS, sql.shared_mapping(128, 64, SEED),
        "addr AS (SELECT row_id, label, ram, string_agg(b, '' ORDER BY pos) AS a FROM bits JOIN map USING (i) GROUP BY row_id, label, ram)",
        sql.MODEL, sql.LABELS, sql.VOTES, sql.bleaching(), sql.winner(), final=sql.PREDICTED,
    ),
)
def classify_wide_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir, address.random_mapping(128, 64, SEED))
    voted = model.classify(rows, VECTOR_BITS.on("x"))
    return voted.select("row_id", "label", "predicted")


@query("classify_lineitem_confusion", sql.chain(LINE_PREFIX, sql.CLASSIFIER, sql.bleaching(), sql.winner(), final=sql.CONFUSION))
def classify_lineitem_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.line_items(spark, sf_dir)
    model = CountModel.train(rows, LINE_MAPPING, LINE_BITS.on("x"))
    return model.confusion(rows, LINE_BITS.on("x"))


@query(
    "classification_accuracy",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(), sql.winner(),
        final="SELECT avg(CASE WHEN truth = predicted THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM won",
    ),
)
def classification_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    return count_model.accuracy(model.classify(rows, VECTOR_BITS.on("x")))


# -- scores under each rule --------------------------------------------------


@query("rank_bleaching", sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(), final=sql.RANKED))
def rank_bleaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir)


@query("rank_bleaching_confidence", sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(confidence=3), final=sql.RANKED))
def rank_bleaching_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, rule=lambda v, n: decide.bleaching(v, n, 3))


@query(
    "rank_without_bleaching",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        final="SELECT row_id, label AS candidate, count(*) FILTER (v > 0) AS score FROM votes GROUP BY row_id, label",
    ),
)
def rank_without_bleaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, rule=lambda v, n: decide.bleaching(v, n, activated=False))


@query(
    "rank_fixed_threshold",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        final="SELECT row_id, label AS candidate, count(*) FILTER (v >= 3) AS score FROM votes GROUP BY row_id, label",
    ),
)
def rank_fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, rule=lambda v, n: decide.fixed_threshold(v, n, 3))


@query("rank_soft_bleaching", sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(sql.EXCESS), final=sql.RANKED))
def rank_soft_bleaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, soft=True)


MARGINS = """
cand AS MATERIALIZED (SELECT DISTINCT row_id, v AS t FROM votes WHERE v > 0 UNION SELECT DISTINCT row_id, 0 FROM votes),
sc AS MATERIALIZED (SELECT row_id, t, label, count(*) FILTER (v > t) AS s FROM votes JOIN cand USING (row_id) GROUP BY row_id, t, label),
pv AS MATERIALIZED (SELECT *, max(s) OVER (PARTITION BY row_id, t) AS top,
  coalesce(max(s) OVER (PARTITION BY row_id, t ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc),
gain AS MATERIALIZED (SELECT row_id, t, max(CASE WHEN before > 0 AND s > before THEN s - before ELSE 0 END) AS lead,
  count(*) FILTER (s = top) > 1 AND max(top) > 0 AS tied FROM pv GROUP BY row_id, t),
run AS MATERIALIZED (SELECT *, coalesce(max(lead) OVER (PARTITION BY row_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM gain),
ok AS MATERIALIZED (SELECT row_id, max(t) FILTER (lead > seen AND NOT tied) AS t FROM run GROUP BY row_id)"""


@query(
    "rank_best_margin_scan",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, MARGINS,
        final="SELECT row_id, label AS candidate, coalesce(max(s) FILTER (sc.t = ok.t), 0) AS score FROM sc JOIN ok USING (row_id) GROUP BY row_id, label",
    ),
)
def rank_best_margin_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, rule=decide.best_margin)


@query(
    "rank_best_margin",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, MARGINS.split("pv AS")[0].strip().rstrip(","),
        "od AS (SELECT row_id, t, s, row_number() OVER (PARTITION BY row_id, t ORDER BY s DESC) AS r FROM sc)",
        "ld AS (SELECT row_id, t, max(s) FILTER (r = 1) - max(s) FILTER (r = 2) AS lead FROM od WHERE r <= 2 GROUP BY row_id, t)",
        "ok AS (SELECT row_id, t FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lead DESC, t) AS r FROM ld) WHERE r = 1 AND lead > 0)",
        final="SELECT l.row_id, l.label AS candidate, coalesce(sc.s, 0) AS score FROM (SELECT DISTINCT row_id, label FROM votes) l "
        "LEFT JOIN ok USING (row_id) LEFT JOIN sc ON sc.row_id = l.row_id AND sc.label = l.label AND sc.t = ok.t",
    ),
)
def rank_best_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, rule=lambda v, n: decide.best_margin(v, n, "margin"))


WEIGHT = "(1 + (ram * 7 + CAST(label AS INTEGER) * 3) % 5) / CAST(4 AS DOUBLE)"


def demo_weights() -> list[list[float]]:
    """A fixed weight per tuple and label (tuple-major)."""
    return [[(1 + (r * 7 + c * 3) % 5) / 4 for c in range(10)] for r in range(16)]


@query(
    "rank_weighted_bleaching",
    sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(f"CASE WHEN v > t THEN {WEIGHT} ELSE 0 END"), final=sql.RANKED),
)
def rank_weighted_bleaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rule(votes: Column, n: int) -> Column:
        return decide.bleaching(votes, n, score=decide.weight_above(demo_weights()))

    return ranked_vectors(spark, sf_dir, rule=rule)


def changed_votes(expression: str) -> str:
    """Votes after a re-weighting; the old ones stay available as ``v``."""
    return f"votes2 AS (SELECT row_id, truth, label, ram, CAST(trunc({expression}) AS BIGINT) AS v FROM votes)"


@query(
    "rank_balanced",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        changed_votes("v * ((SELECT trained FROM labels_ l WHERE l.label = votes.label) / CAST((SELECT sum(trained) FROM labels_) AS DOUBLE))"),
        sql.bleaching(source="votes2"), final=sql.RANKED,
    ),
)
def rank_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, balanced=True)


@query(
    "rank_multi_resolution",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS,
        __import__("ntuple.plans.encoding", fromlist=["MULTI_MAP"]).MULTI_MAP,
        sql.CLASSIFIER,
        changed_votes("v * (SELECT count(*) FROM map m WHERE m.ram = votes.ram)"),
        sql.bleaching(source="votes2"), final=sql.RANKED,
    ),
)
def rank_multi_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, address.multi_resolution_mapping(128, 8, SEED))


@query(
    "rank_weighted_votes",
    sql.chain(VECTOR_PREFIX, sql.CLASSIFIER, changed_votes(f"v * ({WEIGHT})"), sql.bleaching(source="votes2"), final=sql.RANKED),
)
def rank_weighted_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {str(c): [row[c] for row in demo_weights()] for c in range(10)}
    return ranked_vectors(spark, sf_dir, weights=weights)


@query(
    "rank_attention",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        "mm AS (SELECT row_id, label, avg(v) AS mean, max(v) AS top FROM votes GROUP BY row_id, label)",
        "votes2 AS (SELECT row_id, truth, label, ram, CAST(trunc(v * (1 - abs(v - mean) / (top + CAST(1e-9 AS DOUBLE)))) AS BIGINT) AS v FROM votes JOIN mm USING (row_id, label))",
        sql.bleaching(source="votes2"), final=sql.RANKED,
    ),
)
def rank_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, attention=True)


@query(
    "rank_cross_class",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        "votes2 AS (SELECT row_id, truth, label, ram, CASE WHEN total > 0 THEN v * 10 // (total + 1) ELSE v END AS v FROM "
        "(SELECT *, CAST(sum(v) OVER (PARTITION BY row_id, ram) AS BIGINT) AS total FROM votes))",
        sql.bleaching(source="votes2"), final=sql.RANKED,
    ),
)
def rank_cross_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, cross_class=True)


@query(
    "rank_ignore_zero",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, sql.LABELS,
        sql.VOTES.replace("coalesce(m.c, 0)", "CASE WHEN q.a = 0 THEN 0 ELSE coalesce(m.c, 0) END"),
        sql.bleaching(), final=sql.RANKED,
    ),
)
def rank_ignore_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_vectors(spark, sf_dir, ignore_zero=True)


@query(
    "rank_minus_background",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(),
        "seen AS (SELECT DISTINCT ram, a FROM addr)",
        "bg AS (SELECT row_id, count(h.ram) AS hit FROM addr LEFT JOIN seen h USING (ram, a) GROUP BY row_id)",
        final="SELECT row_id, label AS candidate, CAST(trunc(s - 0.3::DOUBLE * hit) AS BIGINT) AS score FROM scores JOIN bg USING (row_id)",
    ),
)
def rank_minus_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    bits = VECTOR_BITS.on("x")
    model = CountModel.train(rows, VECTOR_MAPPING, bits, options=Options(background_beta=0.3), background=VECTOR_MAPPING)
    return candidate_scores(model.rank(rows, bits), model.labels)


NEGATIVE = {
    "uniform": "s - 0.2::DOUBLE * (total - s)",
    "max_competitor": "s - 0.2::DOUBLE * greatest(rival, 0)",
    "normalized": "s * 1000.0::DOUBLE / (1 + 0.2::DOUBLE * (total - s))",
}


def negative_sql(mode: str) -> str:
    return sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(),
        "ev AS (SELECT row_id, label, s, sum(s) OVER (PARTITION BY row_id) AS total, "
        "(SELECT max(o.s) FROM scores o WHERE o.row_id = scores.row_id AND o.label <> scores.label) AS rival FROM scores)",
        final=f"SELECT row_id, label AS candidate, CAST(trunc({NEGATIVE[mode]}) AS BIGINT) AS score FROM ev",
    )


def _negative(mode: str) -> None:
    @query(f"rank_negative_{mode}", negative_sql(mode))
    def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked_vectors(spark, sf_dir, negative_alpha=0.2, negative_mode=mode)


for _mode in NEGATIVE:
    _negative(_mode)


@query(
    "decision_confidence",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER, sql.bleaching(),
        "bs AS (SELECT row_id, max(s) AS best FROM scores GROUP BY row_id)",
        "nd AS (SELECT row_id, best, coalesce(max(s) FILTER (s < best), 0) AS second FROM scores JOIN bs USING (row_id) GROUP BY row_id, best)",
        final="SELECT row_id, CASE WHEN best > 0 THEN round((best - second) / CAST(best AS DOUBLE), 9) END AS confidence FROM nd",
    ),
)
def decision_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    ranked = model.rank(rows, VECTOR_BITS.on("x"))
    return ranked.select("row_id", F.round(decide.confidence(F.col("scores")), 9).alias("confidence"))


# -- documents: unbalanced labels with signal --------------------------------

DOC_BITS = encode.ragged_thermometer(
    [8, 8, 8, 8], [0.0] * 4, [4000.0, 1.0, 1.0, 800.0]
)
DOC_THRESHOLDS = (
    "SELECT f, k, CAST(0 AS DOUBLE) + k * (hi / 8) AS t FROM (VALUES (0, CAST(4000 AS DOUBLE)), (1, CAST(1 AS DOUBLE)), "
    "(2, CAST(1 AS DOUBLE)), (3, CAST(800 AS DOUBLE))) r(f, hi), range(8) b(k)"
)
DOC_PREFIX = sql.DOCUMENTS + "," + sql.bits_from(DOC_THRESHOLDS) + "," + sql.shared_mapping(32, 4, SEED)


@query(
    "classify_documents_balanced",
    sql.chain(
        DOC_PREFIX, sql.CLASSIFIER,
        changed_votes("v * ((SELECT trained FROM labels_ l WHERE l.label = votes.label) / CAST((SELECT sum(trained) FROM labels_) AS DOUBLE))"),
        sql.bleaching(source="votes2"), sql.winner(), final=sql.PREDICTED,
    ),
)
def classify_documents_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    bits = DOC_BITS.on("x")
    model = CountModel.train(docs, address.random_mapping(32, 4, SEED), bits, options=Options(balanced=True))
    return model.classify(docs, bits).select("row_id", "label", "predicted")


@query(
    "pseudo_labels",
    sql.chain(
        sql.documents("LEFT JOIN"), sql.bits_from(DOC_THRESHOLDS), sql.shared_mapping(32, 4, SEED),
        sql.ADDRESSES, sql.MODEL.replace("FROM addr", "FROM addr WHERE label IS NOT NULL"), sql.LABELS,
        sql.VOTES + ",", sql.bleaching().replace("GROUP BY row_id, truth, t, label", "GROUP BY row_id, truth, t, label"), sql.winner(),
        final="SELECT row_id, predicted FROM won WHERE truth IS NULL",
    ).replace(",,", ","),
)
def pseudo_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label get the one of a model trained on the labelled ones."""
    docs = tables.documents(spark, sf_dir, labelled=False)
    bits = DOC_BITS.on("x")
    model = CountModel.train(docs, address.random_mapping(32, 4, SEED), bits)
    return model.classify(docs.where(F.col("label").isNull()), bits).select("row_id", "predicted")


# -- weights and inspection --------------------------------------------------

FIRED = """
fired AS (SELECT label, ram, truth, count(*) AS n FROM votes WHERE v > 0 GROUP BY label, ram, truth),
grid AS (SELECT label, CAST(ram AS INTEGER) AS ram FROM labels_, (SELECT DISTINCT ram FROM map))"""
WEIGHTS_FINAL = (
    "SELECT g.label, g.ram AS ram_id, round(CASE WHEN max(coalesce(w, 0)) OVER (PARTITION BY g.label) > 0 THEN coalesce(w, 0) / "
    "max(coalesce(w, 0)) OVER (PARTITION BY g.label) ELSE coalesce(w, 0) END, 6) AS weight FROM grid g LEFT JOIN raw r ON r.label = g.label AND r.ram = g.ram"
)
RAW = {
    "entropy": "raw AS (SELECT label, ram, 1 + sum(p * log2(p)) / log2(2) AS w FROM (SELECT label, ram, n / CAST(sum(n) OVER (PARTITION BY label, ram) AS DOUBLE) AS p FROM fired) GROUP BY label, ram)",
    "purity": "raw AS (SELECT label, ram, sum(CASE WHEN truth = label THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS w FROM fired GROUP BY label, ram)",
    "information_gain": "tot AS (SELECT sum(trained) AS size FROM labels_), "
    "jn AS (SELECT f.label, f.ram, n / CAST(size AS DOUBLE) AS pj, (trained - n) / CAST(size AS DOUBLE) AS pm, trained / CAST(size AS DOUBLE) AS pc, "
    "sum(n) OVER (PARTITION BY f.label, f.ram) / CAST(size AS DOUBLE) AS pf FROM fired f JOIN labels_ l ON l.label = f.truth, tot), "
    "raw AS (SELECT label, ram, sum(CASE WHEN pj > 0 AND pf > 0 THEN pj * log2(pj / (pf * pc)) ELSE 0 END + CASE WHEN pm > 0 AND 1 - pf > 0 THEN pm * log2(pm / ((1 - pf) * pc)) ELSE 0 END) AS w FROM jn GROUP BY label, ram)",
}


def _weights(metric: str) -> None:
    @query(f"tuple_weights_{metric}", sql.chain(DOC_PREFIX, sql.CLASSIFIER, FIRED, RAW[metric], final=WEIGHTS_FINAL))
    def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = tables.documents(spark, sf_dir)
        bits = DOC_BITS.on("x")
        model = CountModel.train(docs, address.random_mapping(32, 4, SEED), bits)
        found = inspect.ram_weights(model, docs, bits, metric, unlabelled=True)
        return found.withColumn("weight", F.round("weight", 6))


for _metric in RAW:
    _weights(_metric)


@query(
    "tuple_weights_pruned",
    sql.chain(
        DOC_PREFIX, sql.CLASSIFIER, FIRED, RAW["purity"],
        f"ww AS ({WEIGHTS_FINAL})",
        final="SELECT label, ram_id, CASE WHEN weight < 0.9 THEN 0 ELSE weight END AS weight FROM ww",
    ),
)
def tuple_weights_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    bits = DOC_BITS.on("x")
    model = CountModel.train(docs, address.random_mapping(32, 4, SEED), bits)
    found = inspect.ram_weights(model, docs, bits, "purity", unlabelled=True).withColumn("weight", F.round("weight", 6))
    return inspect.prune_weights(found, 0.9)


@query(
    "mental_images",
    sql.chain(
        VECTOR_PREFIX,
        final="SELECT label, i AS bit_index, CAST(sum(b) AS BIGINT) AS intensity FROM bits GROUP BY label, i",
    ),
)
def mental_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bit sits in exactly one tuple here, so an image is the plain count of set bits."""
    return inspect.mental_images(vector_model(spark, sf_dir)[0])


@query(
    "mental_images_per_label",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS, sql.label_mapping(128, 7, SEED, "SELECT DISTINCT label FROM xs"),
        "uses AS (SELECT label, i, count(*) AS k FROM map GROUP BY label, i)",
        final="SELECT b.label, b.i AS bit_index, CAST(sum(b * k) AS BIGINT) AS intensity FROM bits b JOIN uses u ON u.label = b.label AND u.i = b.i GROUP BY b.label, b.i",
    ),
)
def mental_images_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded tuples repeat some bits, which then count repeatedly."""
    return inspect.mental_images(vector_model(spark, sf_dir, per_label(7))[0])


@query(
    "synthesized_rows",
    sql.chain(
        VECTOR_PREFIX,
        "im AS (SELECT i, CAST(sum(b) AS BIGINT) AS level FROM bits WHERE label = '3' GROUP BY i)",
        "dr AS (SELECT r AS row_id, ('0x' || substr(md5('11:' || r), 1, 12))::BIGINT % (SELECT max(level) FROM im) AS d FROM range(200) t(r))",
        final="SELECT row_id, string_agg(CASE WHEN d < level THEN 1 ELSE 0 END, '' ORDER BY i) AS bits FROM dr, im GROUP BY row_id",
    ),
)
def synthesized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = inspect.mental_images(vector_model(spark, sf_dir)[0]).where(F.col("label") == "3")
    return inspect.synthesize(image, 200, 11).select("row_id", F.array_join("bits", "").alias("bits"))


@query(
    "model_size",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL,
        final="SELECT label, count(*) AS bytes, count(DISTINCT ram) AS rams, count(*) AS entries FROM model GROUP BY label",
    ),
)
def model_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = vector_model(spark, sf_dir)
    return inspect.deployed_bytes(model).join(inspect.entry_counts(model.table), "label")


@query(
    "model_configuration",
    """SELECT unnest(['entry_size', 'tuples', 'widest_tuple', 'base', 'shared_mapping', 'labels', 'trained_rows', 'ignore_zero', 'balanced']) AS setting,
              unnest(['128', '16', '8', '2', 'true', CAST(count(DISTINCT label) AS VARCHAR), CAST(count(label) AS VARCHAR), 'false', 'false']) AS value FROM embeddings""",
)
def model_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.configuration(vector_model(spark, sf_dir)[0])


@query(
    "vote_similarity",
    sql.chain(
        VECTOR_PREFIX, sql.CLASSIFIER,
        final="SELECT row_id, label AS candidate, round(CASE WHEN max(v) > 0 THEN sum(v) / CAST(max(v) * count(*) AS DOUBLE) ELSE 0 END, 9) AS similarity FROM votes GROUP BY row_id, label",
    ),
)
def vote_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_model(spark, sf_dir)
    voted = model.votes(rows, VECTOR_BITS.on("x"))
    found = voted.select("row_id", decide.similarity(F.col("votes"), len(model.labels)).alias("scores"))
    names = constant(model.labels, "array<string>")
    return found.select("row_id", F.posexplode("scores").alias("c", "s")).select(
        "row_id", F.get(names, F.col("c")).alias("candidate"), F.round("s", 9).alias("similarity")
    )
