"""Bloom, regression, clustering and imported-network queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import C1, C2, ADD, MIX1, MIX2, h3_constants
from ..functions.scalars import normal_quantile
from ..operators import address, cluster, decide, encode, network, regress, tune
from ..operators.bloom import BloomModel, HashFamily
from ..operators.count_model import class_counts
from ..operators.regress import RegressionModel
from ..session import cut_lineage
from . import sql, tables
from .classifying import MODEL_ROWS, SEED, VECTOR_MAPPING, VECTOR_PREFIX, candidate_scores
from .encoding import VECTOR_BITS
from .registry import query

# -- Bloom -------------------------------------------------------------------

H3 = HashFamily("h3", 64, 3, 5)


def h3_sql(n: int, n_hashes: int, n_slots: int, seed: int, source: str) -> str:
    """slots(ram, a, h, slot) of the distinct addresses in ``source``."""
    return f"""
hc AS (SELECT h, j, ('0x' || substr(md5('h3:{seed}:' || h || ':' || j), 1, 12))::BIGINT AS c FROM range({n_hashes}) a(h), range({n}) b(j)),
slots AS (SELECT s.ram, s.a, hc.h, bit_xor(CASE WHEN (s.a >> CAST(hc.j AS INTEGER)) & 1 = 1 THEN hc.c ELSE 0 END) % {n_slots} AS slot
          FROM (SELECT DISTINCT ram, a FROM {source}) s, hc GROUP BY s.ram, s.a, hc.h)"""


BLOOM_TABLE = """
bloom AS (SELECT m.label, m.ram, s.slot, CAST(sum(m.c) AS BIGINT) AS c FROM model m JOIN slots s ON s.ram = m.ram AND s.a = m.a GROUP BY m.label, m.ram, s.slot)"""
BLOOM_VOTES = """
resolved AS (SELECT s.ram, s.a, l.label, min(coalesce(b.c, 0)) AS c, count(*) FILTER (b.c > 0) AS soft FROM slots s CROSS JOIN labels_ l
             LEFT JOIN bloom b ON b.label = l.label AND b.ram = s.ram AND b.slot = s.slot GROUP BY s.ram, s.a, l.label),
votes AS (SELECT q.row_id, q.label AS truth, r.label, q.ram, r.c AS v FROM addr q JOIN resolved r ON r.ram = q.ram AND r.a = q.a)"""
BLOOM_ROWS = "SELECT label, ram AS ram_id, CAST(slot AS INTEGER) AS slot, c AS cnt FROM bloom"


def vector_bloom(spark: SparkSession, sf_dir: str, hashes: HashFamily, ignore_zero: bool = False):
    rows = tables.vectors(spark, sf_dir)
    return BloomModel.train(rows, VECTOR_MAPPING, VECTOR_BITS.on("x"), hashes=hashes, ignore_zero=ignore_zero), rows


@query(
    "train_bloom_h3",
    sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, h3_sql(8, 3, 64, 5, "addr"), BLOOM_TABLE, final=BLOOM_ROWS),
)
def train_bloom_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_bloom(spark, sf_dir, H3)[0].table


@query(
    "train_bloom_ignore_zero",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, h3_sql(8, 3, 64, 5, "addr"),
        BLOOM_TABLE.replace("GROUP BY", "WHERE m.a <> 0 GROUP BY"), final=BLOOM_ROWS,
    ),
)
def train_bloom_ignore_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_bloom(spark, sf_dir, H3, True)[0].table


def murmur_step(h: str, k: str) -> str:
    """One block of the hash over unsigned 32-bit numbers kept in wider integers."""
    mixed = f"xor({h}, {k})"
    return f"((({mixed} * 8192) % 4294967296 | ({mixed} // 524288)) * 5 + {ADD}) % 4294967296"


ONE = (((C1 << 15) | (C1 >> 17)) & 0xFFFFFFFF) * C2 % (1 << 32)
"""What a block of value 1 contributes; a block of value 0 contributes 0."""


def murmur_sql(n: int, seed: str, prefix: str, source: str, keep: str) -> str:
    """``prefix``_8 style chain of relations: fold ``n`` one-word blocks, then finish."""
    parts = [f"{prefix}0 AS (SELECT {keep}, CAST({seed} AS HUGEINT) AS h FROM {source})"]
    for j in range(n):
        k = f"CAST(CASE WHEN (a >> {j}) & 1 = 1 THEN {ONE} ELSE 0 END AS HUGEINT)"
        parts.append(f"{prefix}{j + 1} AS (SELECT {keep}, {murmur_step('h', k)} AS h FROM {prefix}{j})")
    parts.append(f"{prefix}a AS (SELECT {keep}, xor(h, CAST({4 * n} AS HUGEINT)) AS h FROM {prefix}{n})")
    parts.append(f"{prefix}b AS (SELECT {keep}, xor(h, h // 65536) * {MIX1} % 4294967296 AS h FROM {prefix}a)")
    parts.append(f"{prefix}c AS (SELECT {keep}, xor(h, h // 8192) * {MIX2} % 4294967296 AS h FROM {prefix}b)")
    parts.append(f"{prefix}z AS (SELECT {keep}, xor(h, h // 65536) AS h FROM {prefix}c)")
    return ",\n".join(parts)


MURMUR_SLOTS = (
    "da AS (SELECT DISTINCT ram, a FROM addr),\n"
    + murmur_sql(8, "0", "ma", "da", "ram, a")
    + ",\n"
    + murmur_sql(8, "h1", "mb", "(SELECT ram, a, h AS h1 FROM maz)", "ram, a, h1")
    + ",\nslots AS (SELECT ram, a, i AS h, ((h1 + i * h) % 4294967296) % 64 AS slot FROM mbz, range(3) t(i))"
)


@query("train_bloom_murmur", sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, MURMUR_SLOTS, BLOOM_TABLE, final=BLOOM_ROWS))
def train_bloom_murmur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_bloom(spark, sf_dir, HashFamily("murmur", 64, 3))[0].table


def scrambled(k: str) -> str:
    """Multiply, rotate by 15, multiply: a whole block before it enters the hash."""
    m = f"({k} * {C1} % 4294967296)"
    return f"((({m} * 32768) % 4294967296 | ({m} // 131072)) * {C2} % 4294967296)"


def simhash_sql(n: int, n_slots: int, n_hashes: int, seed: int) -> str:
    """64 sign planes give two blocks; hash i of the signature uses seed i + 1."""
    parts = [
        "da AS (SELECT DISTINCT ram, a FROM addr)",
        f"pl AS (SELECT h, d, CASE WHEN ('0x' || substr(md5('sim:{seed}:' || h || ':' || d), 1, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS g FROM range(64) x(h), range({n}) y(d))",
        "sg AS (SELECT ram, a, h, CASE WHEN sum(((a >> CAST(d AS INTEGER)) & 1) * g) >= 0 THEN 1 ELSE 0 END AS s FROM da, pl GROUP BY ram, a, h)",
        "bl AS (SELECT ram, a, CAST(sum(CASE WHEN h < 32 THEN s * (CAST(1 AS BIGINT) << CAST(h AS INTEGER)) ELSE 0 END) AS HUGEINT) AS k0, "
        "CAST(sum(CASE WHEN h >= 32 THEN s * (CAST(1 AS BIGINT) << CAST(h - 32 AS INTEGER)) ELSE 0 END) AS HUGEINT) AS k1 FROM sg GROUP BY ram, a)",
        f"b0 AS (SELECT ram, a, i, {scrambled('k0')} AS k0, {scrambled('k1')} AS k1, CAST(i + 1 AS HUGEINT) AS h FROM bl, range({n_hashes}) t(i))",
        f"b1 AS (SELECT ram, a, i, k1, {murmur_step('h', 'k0')} AS h FROM b0)",
        f"b2 AS (SELECT ram, a, i, {murmur_step('h', 'k1')} AS h FROM b1)",
        "b3 AS (SELECT ram, a, i, xor(h, CAST(8 AS HUGEINT)) AS h FROM b2)",
        f"b4 AS (SELECT ram, a, i, xor(h, h // 65536) * {MIX1} % 4294967296 AS h FROM b3)",
        f"b5 AS (SELECT ram, a, i, xor(h, h // 8192) * {MIX2} % 4294967296 AS h FROM b4)",
        f"slots AS (SELECT ram, a, i AS h, xor(h, h // 65536) % {n_slots} AS slot FROM b5)",
    ]
    return ",\n".join(parts)


@query(
    "train_bloom_simhash",
    sql.chain(VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, simhash_sql(8, 64, 2, 5), BLOOM_TABLE, final=BLOOM_ROWS),
)
def train_bloom_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_bloom(spark, sf_dir, HashFamily("simhash", 64, 2, 5))[0].table


@query(
    "rank_bloom",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, sql.LABELS, h3_sql(8, 3, 64, 5, "addr"), BLOOM_TABLE, BLOOM_VOTES,
        sql.bleaching(), final=sql.RANKED,
    ),
)
def rank_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_bloom(spark, sf_dir, H3)
    counts = model.as_count_model(rows, VECTOR_BITS.on("x"))
    return candidate_scores(counts.rank(rows, VECTOR_BITS.on("x")), counts.labels)


@query(
    "bloom_membership",
    sql.chain(
        VECTOR_PREFIX, sql.ADDRESSES, sql.MODEL, sql.LABELS, h3_sql(8, 3, 64, 5, "addr"), BLOOM_TABLE, BLOOM_VOTES,
        final="SELECT label, ram AS ram_id, a AS address, c > 0 AS known, c AS min_count, soft AS soft_vote FROM resolved",
    ),
)
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = vector_bloom(spark, sf_dir, H3)
    return model.membership(model.needed_addresses(rows, VECTOR_BITS.on("x")))


@query(
    "bloom_size",
    "SELECT 'one discriminator' AS scope, CAST(ceil(16 * 64 / 8.0) AS BIGINT) AS bytes UNION ALL "
    "SELECT 'all discriminators', CAST(ceil(16 * 64 * count(DISTINCT label) / 8.0) AS BIGINT) FROM embeddings",
)
def bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = vector_bloom(spark, sf_dir, H3)
    return spark.createDataFrame(
        [("one discriminator", model.size_bytes(False)), ("all discriminators", model.size_bytes())],
        "scope string, bytes bigint",
    )


DOC_HASHES = HashFamily("h3", 128, 2, 3)
_Z = ", ".join(f"({k}, CAST({normal_quantile((k + 1) / 7)!r} AS DOUBLE))" for k in range(6))
DOC_GAUSS = f"""
st AS (SELECT f, avg(v) AS mu, stddev_samp(v) AS sd FROM xs GROUP BY f),
fit AS (SELECT f, k, round(mu + sd * z, 9) AS t FROM st, (VALUES {_Z}) q(k, z))"""
TUNED_VOTES = sql.chain(
    sql.DOCUMENTS, DOC_GAUSS, sql.bits_from("SELECT f, k, t FROM fit"), sql.shared_mapping(24, 6, SEED),
    sql.ADDRESSES, sql.MODEL, sql.LABELS, h3_sql(6, 2, 128, 3, "addr"), BLOOM_TABLE, BLOOM_VOTES,
    "mx AS (SELECT CAST(max(v) AS BIGINT) AS top FROM votes)",
    "bs AS (SELECT b FROM mx, range(1, 2 * top + 3) t(b))",
    "scb AS (SELECT b, row_id, truth, label, count(*) FILTER (v >= b) AS s FROM votes, bs GROUP BY b, row_id, truth, label)",
    "wb AS (SELECT b, row_id, truth, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY b, row_id ORDER BY s DESC, label) AS r FROM scb) WHERE r = 1)",
    "acc AS (SELECT b, count(*) FILTER (truth = predicted) AS hit FROM wb GROUP BY b UNION ALL SELECT b, 0 FROM range(-1000000, 1) t(b))",
    final="",
)
SEARCH = """,
walk AS (SELECT 0 AS n, top // 2 AS b, greatest(top // 4, 1) AS step, false AS done FROM mx
         UNION ALL
         SELECT n + 1, nb, greatest(step // 2, 1), nb = b AND step = 1 FROM (
           SELECT n, b, step, CASE WHEN al >= am AND al >= ar THEN b - step WHEN am >= ar THEN b ELSE b + step END AS nb FROM (
             SELECT w.n, w.b, w.step, l.hit AS al, m.hit AS am, r.hit AS ar FROM walk w JOIN acc l ON l.b = w.b - w.step JOIN acc m ON m.b = w.b
             JOIN acc r ON r.b = w.b + w.step WHERE NOT w.done AND w.n < 60))),
best AS (SELECT greatest(1, b) AS threshold FROM walk ORDER BY n DESC LIMIT 1)
"""
SEARCH_SQL = "WITH RECURSIVE " + TUNED_VOTES[len("WITH ") :].rstrip() + SEARCH


def tuned_documents(spark: SparkSession, sf_dir: str) -> tuple[tune.TunedBloom, DataFrame]:
    docs = tables.documents(spark, sf_dir)
    return tune.TunedBloom.fit(docs, "x", "label", "row_id", 6, DOC_HASHES, 6, SEED, digits=9), docs


@query("search_fixed_threshold", SEARCH_SQL + "SELECT threshold FROM best")
def search_fixed_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = tuned_documents(spark, sf_dir)
    return spark.createDataFrame([(found.threshold,)], "threshold bigint")


@query(
    "classify_tuned_bloom",
    SEARCH_SQL + "SELECT row_id, truth AS label, predicted FROM wb JOIN best ON wb.b = best.threshold",
)
def classify_tuned_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, docs = tuned_documents(spark, sf_dir)
    return found.predict(docs).select("row_id", "label", "predicted")


# A tenth of the rows, first in md5 order, is held out of the model and chooses the threshold.
HELD_OUT_SQL = SEARCH_SQL.replace(
    "model AS (SELECT label, ram, a, count(*) AS c FROM addr GROUP BY label, ram, a)",
    "val AS (SELECT row_id, row_number() OVER (ORDER BY u) <= greatest(1, CAST(floor(0.1::DOUBLE * count(*) OVER ()) AS BIGINT)) AS held FROM (SELECT DISTINCT "
    f"row_id, ('0x' || substr(md5('{SEED}:' || row_id), 1, 12))::BIGINT AS u FROM addr)),\n"
    "model AS (SELECT label, ram, a, count(*) AS c FROM addr JOIN val USING (row_id) WHERE NOT held GROUP BY label, ram, a)",
).replace(
    "acc AS (SELECT b, count(*) FILTER (truth = predicted) AS hit FROM wb GROUP BY b",
    "acc AS (SELECT b, count(*) FILTER (truth = predicted AND held) AS hit FROM wb JOIN val USING (row_id) GROUP BY b",
).replace(
    "mx AS (SELECT CAST(max(v) AS BIGINT) AS top FROM votes)",
    "mx AS (SELECT CAST(max(v) AS BIGINT) AS top FROM votes JOIN val USING (row_id) WHERE held)",
)


@query(
    "classify_tuned_bloom_held_out",
    HELD_OUT_SQL + "SELECT row_id, truth AS label, predicted FROM wb JOIN best ON wb.b = best.threshold",
)
def classify_tuned_bloom_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    found = tune.TunedBloom.fit(docs, "x", "label", "row_id", 6, DOC_HASHES, 6, SEED, validation=0.1, digits=9)
    return found.predict(docs).select("row_id", "label", "predicted")


@query("search_thermometer")
def search_thermometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate search over two thresholds per document feature, six candidates each."""
    docs = cut_lineage(tables.documents(spark, sf_dir))
    start = encode.fit_percentile(docs.select(encode.finite("x").alias("x")), "x", 2)
    found, accuracy = tune.search_thermometer(
        docs, "x", "label", "row_id", start, 4, SEED, rounds=1, steps=6
    )
    return found.table(spark).withColumn("accuracy", F.lit(accuracy))


# -- regression --------------------------------------------------------------

ORDER_BITS = encode.ragged_thermometer([6, 6, 6, 6], [0.0] * 4, [15000.0, 12.0, 31.0, 6.0])
ORDER_MAPPING = address.random_mapping(24, 6, SEED)
ORDER_THRESHOLDS = (
    "SELECT f, k, CAST(0 AS DOUBLE) + k * (hi / 6) AS t FROM (VALUES (0, CAST(15000 AS DOUBLE)), (1, CAST(12 AS DOUBLE)), "
    "(2, CAST(31 AS DOUBLE)), (3, CAST(6 AS DOUBLE))) r(f, hi), range(6) b(k)"
)
ORDER_PREFIX = (
    sql.ORDERS + "," + sql.bits_from(ORDER_THRESHOLDS, "row_id, y") + "," + sql.shared_mapping(24, 6, SEED)
    + ",\naddr AS (SELECT row_id, y, ram, CAST(sum(b << pos) AS BIGINT) AS a FROM bits JOIN map USING (i) GROUP BY row_id, y, ram)"
    + ",\nm0 AS (SELECT ram, a, count(*) AS c, sum(y / SCALE) AS s FROM addr GROUP BY ram, a)"
)


def order_prefix(scale: str = "1") -> str:
    return ORDER_PREFIX.replace("SCALE", scale)


def order_model(spark: SparkSession, sf_dir: str, scale: float = 1.0, **options):
    rows = tables.order_rows(spark, sf_dir)
    if scale != 1.0:
        rows = rows.withColumn("y", F.col("y") / scale)
    return RegressionModel.train(rows, ORDER_MAPPING, ORDER_BITS.on("x"), **options), rows


@query(
    "train_regression",
    sql.chain(order_prefix(), final="SELECT ram AS ram_id, a AS address, c AS cnt, round(s, 4) AS sum_y FROM m0"),
)
def train_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_model(spark, sf_dir)[0].table.withColumn("sum_y", F.round("sum_y", 4))


HITS = "hits AS (SELECT q.row_id, coalesce(m.c, 0) AS c, coalesce(m.s, 0) AS s, m.s / m.c AS avg FROM addr q LEFT JOIN m0 m USING (ram, a))"
MEANS = {
    "ratio": (regress.ratio_mean, "sum(s) / sum(c)"),
    "power": (regress.power_mean(2.0), "pow(avg(pow(avg, 2)), 0.5)"),
    "median": (regress.median_mean, "quantile_cont(avg, 0.5)"),
    "harmonic": (regress.harmonic_mean, "count(avg) / sum(1 / avg)"),
    "harmonic_power": (regress.harmonic_power_mean(2.0), "pow(count(avg) / sum(pow(avg, -2)), 0.5)"),
    "geometric": (regress.geometric_mean, "pow(product(avg), 1.0::DOUBLE / count(avg))"),
    "exponential": (regress.exponential_mean, "ln((1 + sum(exp(avg))) / count(avg))"),
    "logistic": (
        regress.logistic_mean(0.5, 0.25, -1.0),
        "1 / (1 + exp(-(0.5 * avg(avg) + 0.25 * count(avg) / count(*) - 1)))",
    ),
}


def _mean_query(name: str) -> None:
    mean, expression = MEANS[name]

    @query(
        f"predict_{name}_mean",
        sql.chain(
            order_prefix("CAST(100000 AS DOUBLE)"), HITS,
            final=f"SELECT row_id, round({expression}, 6) AS prediction FROM hits GROUP BY row_id",
        ),
    )
    def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
        model, rows = order_model(spark, sf_dir, 100000.0)
        found = model.with_mean(mean).predict(rows, ORDER_BITS.on("x"), "row_id")
        return found.withColumn("prediction", F.round("prediction", 6))


for _name in MEANS:
    _mean_query(_name)


@query(
    "regression_votes_gated",
    sql.chain(
        order_prefix(),
        final="SELECT q.row_id, q.ram AS ram_id, CASE WHEN bit_count(q.a) >= 2 AND 6 - bit_count(q.a) >= 1 THEN coalesce(m.c, 0) ELSE 0 END AS vote FROM addr q LEFT JOIN m0 m USING (ram, a)",
    ),
)
def regression_votes_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = order_model(spark, sf_dir, min_one=2, ignore_zero=True)
    return model.votes(rows, ORDER_BITS.on("x"), "row_id").withColumn("ram_id", F.col("ram_id").cast("int"))


def refine_sql(steps: int) -> str:
    parts = []
    for k in range(steps):
        parts.append(
            f"p{k} AS (SELECT q.row_id, q.y, sum(m.s) / sum(m.c) AS p FROM addr q JOIN m{k} m USING (ram, a) GROUP BY q.row_id, q.y)"
        )
        parts.append(
            f"m{k + 1} AS (SELECT m.ram, m.a, m.c, m.s + sum(q.y - p.p) / m.c AS s FROM m{k} m JOIN addr q USING (ram, a) JOIN p{k} p ON p.row_id = q.row_id GROUP BY m.ram, m.a, m.c, m.s)"
        )
    return ",\n".join(parts)


@query(
    "refine_regression",
    sql.chain(order_prefix(), refine_sql(2), final="SELECT ram AS ram_id, a AS address, c AS cnt, round(s, 3) AS sum_y FROM m2"),
)
def refine_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = order_model(spark, sf_dir)
    refined = model.refine(rows, ORDER_BITS.on("x"), "row_id", steps=2)
    return refined.table.withColumn("sum_y", F.round("sum_y", 3))


# -- clustering (order-dependent; checked against a row-by-row model in the tests) ----


def clustered_vectors(spark: SparkSession, sf_dir: str) -> tuple[cluster.ClusterModel, DataFrame]:
    rows = tables.vectors(spark, sf_dir).select("row_id", "label", VECTOR_BITS.bits("x").alias("bits"))
    rule = cluster.Rule(0.3, 40.0, 3)
    return cluster.train_rounds(rows, "bits", 128, 8, SEED, "row_id", "label", rule=rule, first_slice=250), rows


@query("train_clusters")
def train_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_counts(clustered_vectors(spark, sf_dir)[0])


@query("classify_clusters")
def classify_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = clustered_vectors(spark, sf_dir)
    return model.classify(rows, "bits").select(
        "row_id", "label", "predicted", "predicted_cluster"
    )


@query("train_clusters_unsupervised")
def train_clusters_unsupervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors together, in rounds."""
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    model = cluster.train_rounds(rows, "bits", 128, 8, SEED, "row_id", rule=cluster.Rule(0.3, 200.0, 5), first_slice=250)
    return cluster.cluster_counts(model)


@query("classify_clusters_semi_supervised")
def classify_clusters_semi_supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the labelled ones train first, the others under the label they are given."""
    docs = cut_lineage(tables.documents(spark, sf_dir, labelled=False))
    # Documents without a letter share are coded, but no limit of the grid.
    encoder = encode.fit_linear(docs.select(encode.finite("x").alias("x")), "x", 8)
    rows = docs.select("row_id", "label", encoder.bits("x").alias("bits"))
    model = cluster.train_semi_supervised(rows, "bits", 32, 4, SEED, "row_id", rule=cluster.Rule(0.3, 200.0, 4), first_slice=250)
    return model.classify(rows, "bits").select("row_id", "predicted", "predicted_cluster")


@query("predict_order_clusters")
def predict_order_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices from the most similar cluster of all orders, trained in rounds."""
    rows = tables.order_rows(spark, sf_dir).select("row_id", "y", ORDER_BITS.bits("x").alias("bits"))
    model = cluster.train_rounds(rows, "bits", 24, 6, SEED, "row_id", y="y", rule=cluster.Rule(0.5, 2000.0, 4), first_slice=1000)
    found = model.predict(rows, "bits", "row_id", regress.ratio_mean)
    return found.withColumn("prediction", F.round("prediction", 6))


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.event_points(spark, sf_dir)
    bits = encode.ragged_thermometer([8, 8], [0.0, 0.0], [200.0, 24.0])
    return events.select("row_id", "user_id", "value", F.array("value", "hour").alias("x")).select(
        "row_id", "user_id", "value", bits.bits("x").alias("bits")
    )


@query("train_clusters_sequential")
def train_clusters_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupervised clusters of each user's events, row by row in event order."""
    rows = user_points(spark, sf_dir)
    model = cluster.train_sequential(
        rows, "bits", 16, 4, SEED, "row_id", "user_id", rule=cluster.Rule(0.5, 20.0, 4)
    )
    return cluster.cluster_counts(model)


@query("predict_clustered_regression")
def predict_clustered_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values from the most similar cluster of that user."""
    rows = user_points(spark, sf_dir)
    model = cluster.train_sequential(
        rows, "bits", 16, 4, SEED, "row_id", "user_id", "value", cluster.Rule(0.5, 20.0, 4)
    )
    found = model.predict(rows, "bits", "row_id", regress.ratio_mean, "user_id")
    return found.withColumn("prediction", F.round("prediction", 6))


# -- imported networks -------------------------------------------------------


def md5_values(spark: SparkSession, n_first: int, n_second: int, n_third: int, prefix: str) -> DataFrame:
    """Parameter rows ``(a, b, c, value)``, uniform in [-1, 1) by md5."""
    ids = spark.range(n_first * n_second * n_third)
    a = F.floor(F.col("id") / (n_second * n_third)).cast("int")
    b = F.floor(F.col("id") / n_third).cast("int") % n_second
    c = (F.col("id") % n_third).cast("int")
    text = F.concat_ws(":", F.lit(prefix), a.cast("string"), b.cast("string"), c.cast("string"))
    unit = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))
    return ids.select(a.alias("a"), b.alias("b"), c.alias("c"), (unit * 2 - 1).alias("value"))


def parameters_sql(name: str, first: int, second: int, third: int, prefix: str) -> str:
    return (
        f"{name} AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, ('0x' || substr(md5('{prefix}:' || a || ':' || b || ':' || c), 1, 12))::BIGINT "
        f"/ CAST(281474976710656 AS DOUBLE) * 2 - 1 AS value FROM range({first}) x(a), range({second}) y(b), range({third}) z(c))"
    )


def lut_parts(spark: SparkSession) -> tuple[DataFrame, list[address.Mapping], list[str], float]:
    """Parameter table, mappings, labels and temperature of a network of two layers."""
    values = md5_values(spark, 2, 46, 64, "lut").select(
        F.col("a").alias("layer"), F.col("b").alias("lut"), F.col("c").alias("addr"), "value"
    )
    mappings = [
        address.stacked_permutations(128, 6, 46, 21),
        address.stacked_permutations(46, 6, 46, 22),
    ]
    return values, mappings, [str(i) for i in range(10)], 2.0


def lut_network(spark: SparkSession) -> network.LutNetwork:
    return network.LutNetwork.of(*lut_parts(spark))


def stacked_sql(name: str, inputs: int, need: int, seed: int, size: int) -> str:
    times = -(-need // inputs)
    return f"""
{name} AS (SELECT CAST(p // {size} AS INTEGER) AS lut, CAST(p % {size} AS INTEGER) AS pos, i FROM
  (SELECT CAST(i AS INTEGER) AS i, n * {inputs} + row_number() OVER (PARTITION BY n ORDER BY md5('{seed}:' || n || ':' || i)) - 1 AS p
   FROM range({times}) a(n), range({inputs}) b(i)) WHERE p < {need})"""


LUT_PREFIX = (
    sql.VECTORS + "," + sql.VECTOR_BITS + ",\n" + parameters_sql("par", 2, 46, 64, "lut") + ","
    + stacked_sql("map0", 128, 276, 21, 6) + "," + stacked_sql("map1", 46, 276, 22, 6)
    + """,
a0 AS (SELECT row_id, lut, CAST(sum(b << pos) AS BIGINT) AS addr FROM bits JOIN map0 USING (i) GROUP BY row_id, lut),
o0 AS (SELECT row_id, lut AS i, CASE WHEN value > 0 THEN 1 ELSE 0 END AS b FROM a0 JOIN par p ON p.a = 0 AND p.b = lut AND p.c = addr),
a1 AS (SELECT row_id, lut, CAST(sum(b << pos) AS BIGINT) AS addr FROM o0 JOIN map1 USING (i) GROUP BY row_id, lut),
o1 AS (SELECT row_id, lut, CASE WHEN value > 0 THEN 1 ELSE 0 END AS b FROM a1 JOIN par p ON p.a = 1 AND p.b = lut AND p.c = addr),
scores AS (SELECT row_id, CAST((lut + 4) // 5 AS VARCHAR) AS label, sum(b) / CAST(2 AS DOUBLE) AS s, NULL AS truth FROM o1 GROUP BY row_id, (lut + 4) // 5)"""
)


@query("rank_lut_network", sql.chain(LUT_PREFIX, final="SELECT row_id, label AS candidate, s AS score FROM scores"))
def rank_lut_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = lut_network(spark)
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    return rows.select("row_id", F.posexplode(net.scores(F.col("bits"))).alias("c", "score")).select(
        "row_id", F.col("c").cast("string").alias("candidate"), "score"
    )


@query("classify_lut_network", sql.chain(LUT_PREFIX, sql.winner(direction="ASC"), final="SELECT row_id, predicted FROM won"))
def classify_lut_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    return lut_network(spark).predict(rows, "bits").select("row_id", "predicted")


@query("classify_lut_network_join", sql.chain(LUT_PREFIX, sql.winner(direction="ASC"), final="SELECT row_id, predicted FROM won"))
def classify_lut_network_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the parameters left in their table, as for networks of any size."""
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    values, mappings, labels, tau = lut_parts(spark)
    return network.LutTables(values, tuple(mappings), labels, tau).predict(rows, "bits").select("row_id", "predicted")


@query(
    "lut_spectrum",
    sql.chain(
        "addr AS (SELECT DISTINCT l_linenumber, l_suppkey FROM lineitem)",
        "lv AS (SELECT l_linenumber AS lut, l_suppkey % 8 AS addr, count(*) AS value FROM lineitem GROUP BY 1, 2)",
        "co AS (SELECT lut, j, sum(value * CASE WHEN bit_count(addr & ~j) % 2 = 0 THEN 1 ELSE -1 END) / CAST(8 AS DOUBLE) AS c FROM lv, range(8) t(j) GROUP BY lut, j)",
        final="SELECT 0 AS layer, lut, round(sum(c * c), 6) AS energy FROM co GROUP BY lut",
    ),
)
def lut_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables over line numbers: item counts by the last three bits of the supplier."""
    values = (
        tables.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").alias("lut"), (F.col("l_suppkey") % 8).alias("addr"))
        .agg(F.count(F.lit(1)).alias("value"))
        .withColumn("layer", F.lit(0))
    )
    return network.lut_spectrum(values, 3).withColumn("energy", F.round("energy", 6))


def bloom_parts(spark: SparkSession):
    """Values, mapping, hash constants, slots, labels and bias of each submodel."""
    labels = [str(i) for i in range(10)]
    for number, (size, slots) in enumerate([(12, 32), (9, 16)]):
        mapping = address.padded_permutation(128, size, 31 + number)
        values = md5_values(spark, 10, mapping.n_rams, slots, f"cb{number}").select(
            F.col("a").cast("string").alias("label"),
            F.col("b").alias("filter"),
            F.col("c").alias("slot"),
            "value",
        )
        constants = h3_constants(size, 2, 41 + number)
        bias = [0.5 if number == 0 else 0.0] * 10
        yield values, mapping, constants, slots, labels, bias


def bloom_layers(spark: SparkSession) -> list[network.BloomLayer]:
    return [network.BloomLayer.of(*parts, bias=bias) for *parts, bias in bloom_parts(spark)]


def bloom_tables(spark: SparkSession) -> list[network.BloomTables]:
    layers = []
    for *parts, bias in bloom_parts(spark):
        table = spark.createDataFrame(list(zip(parts[-1], bias, strict=True)), "label string, bias double")
        layers.append(network.BloomTables(*parts, bias=table))
    return layers


def layer_sql(number: int, size: int, slots: int) -> str:
    rams = -(-128 // size)
    total = rams * size
    return f"""
pm{number} AS (SELECT CAST((rn - 1) // {size} AS INTEGER) AS ram, CAST((rn - 1) % {size} AS INTEGER) AS pos, i FROM
  (SELECT CAST(i AS INTEGER) AS i, row_number() OVER (ORDER BY md5('{31 + number}:' || i)) AS rn FROM range({total}) t(i))),
hc{number} AS (SELECT h, j, ('0x' || substr(md5('h3:{41 + number}:' || h || ':' || j), 1, 12))::BIGINT AS c FROM range(2) a(h), range({size}) b(j)),
{parameters_sql(f"cb{number}", 10, rams, slots, f"cb{number}")},
sl{number} AS (SELECT row_id, truth, ram, h, bit_xor(CASE WHEN b = 1 THEN c ELSE 0 END) % {slots} AS slot FROM
  (SELECT r.row_id, r.label AS truth, m.ram, m.pos, coalesce(x.b, 0) AS b FROM (SELECT DISTINCT row_id, label FROM bits) r CROSS JOIN pm{number} m
   LEFT JOIN bits x ON x.row_id = r.row_id AND x.i = m.i) q JOIN hc{number} ON hc{number}.j = q.pos GROUP BY row_id, truth, ram, h),
rs{number} AS (SELECT s.row_id, s.truth, v.a, s.ram, min(CASE WHEN v.value >= 0 THEN 1 ELSE -1 END) AS r
  FROM sl{number} s JOIN cb{number} v ON v.b = s.ram AND v.c = s.slot GROUP BY s.row_id, s.truth, v.a, s.ram)"""


ENSEMBLE = (
    sql.VECTORS + "," + sql.VECTOR_BITS + "," + layer_sql(0, 12, 32) + "," + layer_sql(1, 9, 16)
    + """,
scores AS (SELECT row_id, label, sum(r) AS s, NULL AS truth FROM (
  SELECT row_id, CAST(a AS VARCHAR) AS label, sum(r) + 0.5::DOUBLE AS r FROM rs0 GROUP BY row_id, a
  UNION ALL SELECT row_id, CAST(a AS VARCHAR), sum(r) FROM rs1 GROUP BY row_id, a) GROUP BY row_id, label)"""
)


@query("classify_bloom_ensemble", sql.chain(ENSEMBLE, sql.winner(direction="ASC"), final="SELECT row_id, predicted FROM won").replace("CASE WHEN s < 0 THEN '' ELSE label END", "label"))
def classify_bloom_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    return network.ensemble_predict(bloom_layers(spark), rows, "bits").select("row_id", "predicted")


@query("classify_bloom_ensemble_join", sql.chain(ENSEMBLE, sql.winner(direction="ASC"), final="SELECT row_id, predicted FROM won").replace("CASE WHEN s < 0 THEN '' ELSE label END", "label"))
def classify_bloom_ensemble_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all parameters left in their tables, as for ensembles of any size."""
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    return network.ensemble_tables_predict(bloom_tables(spark), rows, "bits").select("row_id", "predicted")


PRUNED = sql.chain(
    sql.VECTORS, sql.VECTOR_BITS, layer_sql(0, 12, 32),
    "pl AS (SELECT a, ram, -sum(CASE WHEN CAST(a AS VARCHAR) = truth THEN -9 * r ELSE r END) AS score FROM rs0 GROUP BY a, ram)",
    "pf AS (SELECT ram, max(score) AS score FROM pl GROUP BY ram)",
    final='SELECT ram AS "filter", CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (ORDER BY score, ram) AS r FROM pf) WHERE r > CAST(trunc(0.27::DOUBLE * 11) AS BIGINT)',
)


@query("prune_filters_join", PRUNED)
def prune_filters_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pruning scores from the tables of a submodel of any size."""
    layer = bloom_tables(spark)[0]
    rows = tables.vectors(spark, sf_dir).select("label", VECTOR_BITS.bits("x").alias("bits"))
    scores = layer.filter_scores(rows, "bits", "label")
    return network.filters_to_keep(scores, layer.mapping.n_rams, 0.27).select(
        "filter", F.col("score").cast("bigint").alias("score")
    )


@query("prune_filters", PRUNED)
def prune_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = bloom_layers(spark)[0]
    rows = tables.vectors(spark, sf_dir).select("label", VECTOR_BITS.bits("x").alias("bits"))
    scores = network.filter_scores(layer, rows, "bits", "label")
    return network.filters_to_keep(scores, layer.mapping.n_rams, 0.27).select(
        "filter", F.col("score").cast("bigint").alias("score")
    )
