"""Row preparation, splits, sweeps, model edits and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import address, count_model, encode, prep, sweep
from ..operators.address import tuple_rows
from ..session import scratch_folder
from ..streaming import durable, online
from . import sql, tables
from .classifying import SEED, VECTOR_MAPPING, vector_model
from .encoding import VECTOR_BITS
from .registry import query


def md5_number(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 12))::BIGINT"


@query(
    "split_rows",
    f"""SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY {md5_number(7, "o_orderkey")}) <=
        (SELECT CAST(trunc(0.2::DOUBLE * count(*)) AS BIGINT) FROM orders) AS is_validation FROM orders""",
)
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return prep.split_rows(rows, "row_id", 0.2, 7)


@query(
    "stratified_split",
    f"""SELECT event_id AS row_id, event_type AS label,
        row_number() OVER (PARTITION BY event_type ORDER BY {md5_number(7, "event_id")})
        <= trunc(0.2::DOUBLE * count(*) OVER (PARTITION BY event_type)) AS is_test FROM events""",
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("label")
    )
    return prep.stratified_split(rows, "row_id", "label", 0.2, 7).select("row_id", "label", "is_test")


@query(
    "stratified_cap",
    f"""SELECT row_id, label FROM (SELECT event_id AS row_id, event_type AS label,
        row_number() OVER (PARTITION BY event_type ORDER BY {md5_number(7, "event_id")}) AS r,
        count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER () AS total FROM events) WHERE r <= n * 777 // total""",
)
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").alias("label")
    )
    return prep.stratified_cap(rows, "row_id", "label", 777, 7).select("row_id", "label")


@query(
    "min_max_scaled",
    """WITH st AS (SELECT min(l_quantity) a0, max(l_quantity) b0, min(l_extendedprice) a1, max(l_extendedprice) b1 FROM lineitem)
       SELECT l_returnflag || l_linestatus AS label, round(avg((l_quantity - a0) / (b0 - a0)), 6) AS quantity,
              round(avg((l_extendedprice - a1) / (b1 - a1)), 6) AS price FROM lineitem, st GROUP BY 1""",
)
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.line_items(spark, sf_dir)
    scaled = prep.min_max_scaled(rows, rows, "x")
    return scaled.groupBy("label").agg(
        F.round(F.avg(F.get("x", F.lit(0))), 6).alias("quantity"),
        F.round(F.avg(F.get("x", F.lit(1))), 6).alias("price"),
    )


@query(
    "impute_mean",
    """WITH v AS (SELECT o_orderkey AS row_id, TRY_CAST(split_part(o_orderpriority, '-', 2) AS DOUBLE) AS a,
                  CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_totalprice END AS b FROM orders)
       SELECT row_id, coalesce(a, (SELECT avg(a) FROM v)) AS a, round(coalesce(b, (SELECT avg(b) FROM v)), 6) AS b FROM v""",
)
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.get(F.split("o_orderpriority", "-"), F.lit(1)).alias("a"),
        F.when(F.col("o_totalprice") > 200000, F.lit("none")).otherwise(F.col("o_totalprice").cast("string")).alias("b"),
    )
    return prep.impute_mean(rows, ["a", "b"]).withColumn("b", F.round("b", 6))


@query(
    "drop_nan_rows",
    "SELECT event_type, count(*) AS n FROM events WHERE value > 1 GROUP BY event_type",
)
def drop_nan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logarithm of values up to 1 is made NaN first."""
    rows = tables.table(spark, sf_dir, "events").select(
        "event_type",
        F.array(F.when(F.col("value") > 1, F.log("value")).otherwise(F.lit(float("nan")))).alias("x"),
    )
    return prep.without_nan(rows, "x").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "supervision_kind",
    """SELECT count(*) AS n_rows, count(quality) AS n_labels, 0 AS n_targets,
              CASE WHEN count(quality) = 0 THEN 'unsupervised' WHEN count(quality) < count(*) THEN 'semi_supervised' ELSE 'supervised' END AS kind,
              'classification' AS task FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def supervision_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir, labelled=False)
    return prep.supervision(docs.select("label", F.lit(None).cast("double").alias("y")))


@query(
    "unlabelled_rows",
    "SELECT d.doc_id AS row_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL",
)
def unlabelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir, labelled=False).where(F.col("label").isNull()).select("row_id")


@query(
    "replace_rows",
    """SELECT doc_id, quality, toxic FROM labels WHERE toxic = 0
       UNION ALL SELECT doc_id, 0, toxic FROM labels WHERE toxic = 1""",
)
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "labels")
    updates = rows.where(F.col("toxic") == 1).withColumn("quality", F.lit(0))
    return prep.replace_rows(rows, updates, ["doc_id"])


PREFIX = sql.VECTORS + "," + sql.VECTOR_BITS + "," + sql.shared_mapping(128, 8, SEED)


@query(
    "edit_model_entries",
    sql.chain(
        PREFIX, sql.ADDRESSES, sql.MODEL,
        final="SELECT label, ram AS ram_id, a AS address, CASE WHEN a = 0 THEN 99 ELSE c END AS cnt FROM model",
    ),
)
def edit_model_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vector_model(spark, sf_dir)[0].table
    edits = table.where(F.col("address") == 0).withColumn("cnt", F.lit(99).cast("bigint"))
    return prep.replace_rows(table, edits, ["label", "ram_id", "address"])


@query(
    "compare_models",
    sql.chain(
        PREFIX, sql.ADDRESSES,
        "pos AS (SELECT row_id FROM xs WHERE f = 0 AND v > 0)",
        "ma AS (SELECT label, ram, a, count(*) AS c FROM addr GROUP BY label, ram, a)",
        "mb AS (SELECT label, ram, a, count(*) AS c FROM addr WHERE row_id IN (SELECT row_id FROM pos) GROUP BY label, ram, a)",
        final="SELECT label, ram AS ram_id, a AS address, ma.c AS left_count, mb.c AS right_count FROM ma FULL JOIN mb USING (label, ram, a) WHERE ma.c IS DISTINCT FROM mb.c",
    ),
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    bits = VECTOR_BITS.on("x")
    whole = count_model.count_addresses(rows, VECTOR_MAPPING, bits)
    part = count_model.count_addresses(rows.where(F.get("x", F.lit(0)) > 0), VECTOR_MAPPING, bits)
    found = prep.difference(whole, part, ["label", "ram_id", "address"], ["cnt"])
    return found.select(
        "label", "ram_id", "address", F.col("a.cnt").alias("left_count"), F.col("b.cnt").alias("right_count")
    )


# -- sweeps ------------------------------------------------------------------


@query(
    "sweep_models",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS,
        "grid AS (SELECT s AS seed, n AS size FROM (VALUES (1), (2)) a(s), (VALUES (4), (8)) b(n))",
        "map AS (SELECT seed, size, CAST((rn - 1) // size AS INTEGER) AS ram, CAST((rn - 1) % size AS INTEGER) AS pos, i FROM "
        "(SELECT seed, size, CAST(i AS INTEGER) AS i, row_number() OVER (PARTITION BY seed, size ORDER BY md5(seed || ':' || i)) AS rn FROM grid, range(128) t(i)))",
        "addr AS (SELECT seed, size, row_id, label, ram, sum(b << pos) AS a FROM bits JOIN map USING (i) GROUP BY ALL)",
        final="SELECT 'n' || size || '-s' || seed AS model_id, count(*) AS entries, CAST(sum(c) AS BIGINT) AS trained FROM "
        "(SELECT seed, size, label, ram, a, count(*) AS c FROM addr GROUP BY seed, size, label, ram, a) GROUP BY seed, size",
    ),
)
def sweep_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models, two tuple sizes by two seeds, counted in one job with the model in the key."""
    rows = tables.vectors(spark, sf_dir)
    grid = {
        f"n{size}-s{seed}": address.random_mapping(128, size, seed) for seed in (1, 2) for size in (4, 8)
    }
    merged = address.Mapping(128, {name: m.of("") for name, m in grid.items()})
    addressed = tuple_rows(rows, merged, VECTOR_BITS.on("x"), ["label"], model_label="model_id")
    model = addressed.groupBy("model_id", "label", "ram_id", "address").agg(F.count(F.lit(1)).alias("cnt"))
    return model.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("cnt").alias("trained")
    )


SWEEP_PREFIX = sql.chain(
    sql.VECTORS, sql.VECTOR_BITS,
    "grid AS (SELECT s AS seed, n AS size FROM (VALUES (1), (2), (3)) a(s), (VALUES (4), (8), (16)) b(n))",
    "map AS (SELECT seed, size, CAST((rn - 1) // size AS INTEGER) AS ram, CAST((rn - 1) % size AS INTEGER) AS pos, i FROM "
    "(SELECT seed, size, CAST(i AS INTEGER) AS i, row_number() OVER (PARTITION BY seed, size ORDER BY md5(seed || ':' || i)) AS rn FROM grid, range(128) t(i)))",
    "addr AS (SELECT 'n' || size || '-s' || seed AS model_id, row_id, label, ram, sum(b << pos) AS a FROM bits JOIN map USING (i) GROUP BY ALL)",
    "model AS (SELECT model_id, label, ram, a, count(*) AS c FROM addr WHERE row_id % 4 <> 0 GROUP BY ALL)",
    "labs AS (SELECT DISTINCT label FROM addr WHERE row_id % 4 <> 0)",
    "votes AS (SELECT x.model_id || ':' || x.row_id AS row_id, x.label AS truth, x.ram, l.label, coalesce(m.c, 0) AS v FROM addr x CROSS JOIN labs l "
    "LEFT JOIN model m ON m.model_id = x.model_id AND m.label = l.label AND m.ram = x.ram AND m.a = x.a WHERE x.row_id % 4 = 0)",
    sql.bleaching(), sql.winner(),
    "cells AS (SELECT split_part(row_id, ':', 1) AS model_id, count(*) AS rows, CAST(sum(CASE WHEN predicted = truth THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM won GROUP BY 1)",
    final="SELECT model_id, entries, rows, hits, hits / rows AS test_acc FROM cells JOIN (SELECT model_id, count(*) AS entries FROM model GROUP BY model_id) USING (model_id)",
)


def sweep_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tuple sizes by three seeds, trained on three quarters of the vectors, tested on the rest."""
    rows = tables.vectors(spark, sf_dir)
    grid = {f"n{size}-s{seed}": address.random_mapping(128, size, seed) for seed in (1, 2, 3) for size in (4, 8, 16)}
    held = F.col("row_id") % 4 == 0
    return sweep.sweep(rows.where(~held), rows.where(held), grid, VECTOR_BITS.on("x"), "row_id")


@query("sweep_scores", SWEEP_PREFIX)
def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of every cell of the grid, all trained and scored in one job."""
    return sweep_cells(spark, sf_dir)


def sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("model_id", "-s")
    return sweep_cells(spark, sf_dir).select(
        F.lit("embeddings").alias("dataset"), parts[0].alias("hp_id"), parts[1].cast("int").alias("seed"), "test_acc"
    )


@query(
    "sweep_summary",
    f"""WITH res AS ({SWEEP_PREFIX}), su AS (SELECT split_part(model_id, '-s', 1) AS hp_id, avg(test_acc) AS m, stddev_samp(test_acc) AS d, count(*) AS seeds FROM res GROUP BY 1)
        SELECT 'embeddings' AS dataset, hp_id, round(m, 9) AS mean_acc, round(d, 9) AS std_acc, seeds, row_number() OVER (ORDER BY round(m, 9) DESC, hp_id) = 1 AS best FROM su""",
)
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each configuration over its seeds, and which one is best."""
    found = prep.run_summary(sweep_runs(spark, sf_dir)).withColumns(
        {"mean_acc": F.round("mean_acc", 9), "std_acc": F.round("std_acc", 9)}
    )
    best = prep.best_configuration(found.select("dataset", "hp_id", F.col("mean_acc").alias("test_acc")))
    marked = best.select("dataset", "hp_id", F.lit(True).alias("best"))
    return found.join(marked, ["dataset", "hp_id"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


RESULTS = """
res AS (SELECT l_returnflag AS dataset, CAST(l_linenumber AS VARCHAR) AS hp_id, l_suppkey AS seed, round(avg(l_discount * 10), 9) AS test_acc
        FROM lineitem GROUP BY 1, 2, 3)"""


def sweep_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows per data set, configuration and seed, made from discounts."""
    return (
        tables.table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("dataset"),
            F.col("l_linenumber").cast("string").alias("hp_id"),
            F.col("l_suppkey").alias("seed"),
        )
        .agg(F.round(F.avg(F.col("l_discount") * 10), 9).alias("test_acc"))
    )


@query(
    "best_configuration",
    sql.chain(
        RESULTS,
        "me AS (SELECT dataset, hp_id, avg(test_acc) AS m, count(*) AS runs FROM res GROUP BY 1, 2)",
        final="SELECT dataset, hp_id, round(m, 6) AS mean_acc, runs FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY m DESC, hp_id) AS r FROM me) WHERE r = 1",
    ),
)
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.best_configuration(sweep_results(spark, sf_dir)).withColumn("mean_acc", F.round("mean_acc", 6))


@query(
    "run_summary",
    sql.chain(
        RESULTS,
        final="SELECT dataset, hp_id, round(avg(test_acc), 6) AS mean_acc, round(coalesce(stddev_samp(test_acc), 0), 6) AS std_acc, count(DISTINCT seed) AS seeds FROM res GROUP BY 1, 2",
    ),
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prep.run_summary(sweep_results(spark, sf_dir))
    return found.withColumn("mean_acc", F.round("mean_acc", 6)).withColumn("std_acc", F.round("std_acc", 6))


@query(
    "pending_cells",
    """WITH done AS (SELECT DISTINCT l_returnflag AS dataset, CAST(l_linenumber AS VARCHAR) AS hp_id, l_suppkey AS seed FROM lineitem WHERE l_discount > 0.09),
            grid AS (SELECT DISTINCT l_returnflag AS dataset, CAST(l_linenumber AS VARCHAR) AS hp_id, l_suppkey AS seed FROM lineitem)
       SELECT * FROM grid EXCEPT SELECT * FROM done""",
)
def pending_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linenumber").cast("string").alias("hp_id"),
        F.col("l_suppkey").alias("seed"),
        "l_discount",
    )
    keys = ["dataset", "hp_id", "seed"]
    return prep.pending_cells(items.select(*keys).distinct(), items.where(F.col("l_discount") > 0.09), keys)


@query(
    "against_published",
    sql.chain(
        RESULTS,
        "me AS (SELECT dataset, hp_id, avg(test_acc) AS m FROM res GROUP BY 1, 2)",
        "be AS (SELECT dataset, max(m) AS m FROM me GROUP BY 1)",
        "pu AS (SELECT l_returnflag AS dataset, round(avg(l_tax) * 10, 9) AS paper_acc FROM lineitem GROUP BY 1)",
        final="SELECT dataset, round(paper_acc, 6) AS paper_acc, round(m, 6) AS mean_acc, round(m - paper_acc, 6) AS gap, abs(m - paper_acc) > 0.05 AS flag FROM pu LEFT JOIN be USING (dataset)",
    ),
)
def against_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = (
        tables.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("dataset"))
        .agg(F.round(F.avg("l_tax") * 10, 9).alias("paper_acc"))
    )
    best = prep.best_configuration(sweep_results(spark, sf_dir))
    found = prep.against_published(best, published)
    return found.select(
        "dataset", *[F.round(c, 6).alias(c) for c in ("paper_acc", "mean_acc", "gap")], "flag"
    )


# -- streams -----------------------------------------------------------------

EVENT_BITS = encode.ragged_thermometer([8, 8], [0.0, 0.0], [200.0, 24.0])
EVENT_MAPPING = address.random_mapping(16, 4, SEED)
EVENT_PREFIX = sql.EVENT_POINTS + """,
xs AS (SELECT row_id, label, ts, 0 AS f, value AS v FROM ev UNION ALL SELECT row_id, label, ts, 1, hour FROM ev),""" + sql.bits_from(
    "SELECT f, k, CAST(0 AS DOUBLE) + k * (hi / 8) AS t FROM (VALUES (0, CAST(200 AS DOUBLE)), (1, CAST(24 AS DOUBLE))) r(f, hi), range(8) b(k)",
    "row_id, label, ts",
) + "," + sql.shared_mapping(16, 4, SEED) + """,
addr AS (SELECT row_id, label, ts, ram, CAST(sum(b << pos) AS BIGINT) AS a FROM bits JOIN map USING (i) GROUP BY row_id, label, ts, ram)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.event_points(spark, sf_dir).select(
        "row_id", "ts", "label", F.array("value", "hour").alias("x")
    )


@query(
    "train_event_model",
    sql.chain(EVENT_PREFIX, final="SELECT label, ram AS ram_id, a AS address, count(*) AS cnt FROM addr GROUP BY label, ram, a"),
)
def train_event_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the continuous model holds after the whole stream (the stream itself is in the tests)."""
    return online.train_stream(event_rows(spark, sf_dir), EVENT_MAPPING, EVENT_BITS.on("x"))


@query(
    "window_models",
    sql.chain(
        EVENT_PREFIX,
        "pieces AS (SELECT label, ram, a, make_timestamp(((epoch_us(ts) // 259200000000) - o) * 259200000000) AS start_ FROM addr, range(2) t(o))",
        final="SELECT start_ AS start, start_ + INTERVAL 6 DAY AS \"end\", label, ram AS ram_id, a AS address, count(*) AS cnt FROM pieces GROUP BY start_, label, ram, a",
    ),
)
def window_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of six-day windows every three days: old rows are forgotten."""
    return online.window_model(
        event_rows(spark, sf_dir), EVENT_MAPPING, EVENT_BITS.on("x"), "ts", "6 days", "3 days", "1 day"
    )


@query(
    "durable_model",
    sql.chain(
        EVENT_PREFIX,
        final="""SELECT label, ram AS ram_id, a AS address, count(*) AS cnt FROM addr WHERE label <> 'view' GROUP BY label, ram, a
        UNION ALL SELECT label, -1, 0, count(*) FROM ev WHERE label <> 'view' GROUP BY label""",
    ),
)
def durable_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that began with half of the events, was continued by a stream's batches in two
    queries, compacted between them, and then had to forget one event type; read back merged."""
    rows, bits = event_rows(spark, sf_dir), EVENT_BITS.on("x")
    kept = durable.DurableModel(spark, scratch_folder(spark))
    part = F.pmod(F.xxhash64("row_id"), F.lit(4))
    kept.start_from(count_model.CountModel.train(rows.where(part < 2), EVENT_MAPPING, bits))
    kept.append("morning", 0, durable.changes(rows.where(part == 2), EVENT_MAPPING, bits))
    kept.compact()
    kept.append("evening", 0, durable.changes(rows.where(part == 3), EVENT_MAPPING, bits))
    kept.append("evening", 1, durable.negated(durable.changes(rows.where(F.col("label") == "view"), EVENT_MAPPING, bits)))
    return kept.contents()
