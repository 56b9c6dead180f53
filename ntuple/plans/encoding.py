"""Encoder, mapping and address queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import pack_bits, unpack_bits
from ..operators import address, encode, order
from . import sql, tables
from .registry import query

LINE_BITS = encode.ragged_thermometer([8, 8, 8, 8], [0.0] * 4, [50.0, 100000.0, 0.1, 0.08])
VECTOR_BITS = encode.fixed_thermometer(64, 2, -0.5, 0.5)




def ones_per_bit(df: DataFrame, bits, keys: list[str]) -> DataFrame:
    """How many rows set each bit: a compact result over the whole table."""
    return (
        df.select(*keys, F.posexplode(bits).alias("bit_index", "b"))
        .groupBy(*keys, "bit_index")
        .agg(F.sum("b").alias("ones"))
    )


ONES = "SELECT label, i AS bit_index, CAST(sum(b) AS BIGINT) AS ones FROM bits GROUP BY label, i"
BIT_TEXT = "SELECT row_id, string_agg(b, '' ORDER BY i) AS bits FROM bits GROUP BY row_id"
THRESHOLDS = "SELECT f AS feature, k, round(t, 6) AS threshold FROM fitted"


def threshold_rows(encoder: encode.Thermometer, spark: SparkSession) -> DataFrame:
    return encoder.table(spark).withColumn("threshold", F.round("threshold", 6))


@query(
    "encode_constant_threshold",
    sql.chain(
        sql.LINES,
        "bits AS (SELECT label, f AS i, CASE WHEN v >= 10 THEN 1 ELSE 0 END AS b FROM xs)",
        final=ONES,
    ),
)
def encode_constant_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ones_per_bit(tables.line_items(spark, sf_dir), encode.constant_threshold("x", 10.0), ["label"])


@query(
    "encode_row_mean",
    sql.chain(
        sql.VECTORS,
        "m AS (SELECT row_id, avg(v) AS m FROM xs GROUP BY row_id)",
        "bits AS (SELECT row_id, f AS i, CASE WHEN v >= m THEN 1 ELSE 0 END AS b FROM xs JOIN m USING (row_id))",
        final=BIT_TEXT,
    ),
)
def encode_row_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    return rows.select("row_id", F.array_join(encode.row_mean_threshold("x"), "").alias("bits"))


@query("encode_fixed_thermometer", sql.chain(sql.VECTORS, sql.VECTOR_BITS, final=BIT_TEXT))
def encode_fixed_thermometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    return rows.select("row_id", F.array_join(VECTOR_BITS.bits("x"), "").alias("bits"))


@query(
    "encode_ragged_thermometer",
    sql.chain(
        sql.LINES,
        sql.bits_from(
            "SELECT f, k, CAST(lo AS DOUBLE) + k * ((CAST(hi AS DOUBLE) - lo) / n) AS t FROM "
            "(VALUES (0, 2, 0, 50), (1, 4, 1000, 90000), (2, 3, 0, 1), (3, 5, 0, 1)) r(f, n, lo, hi), range(5) b(k) WHERE k < n"
        ),
        final=ONES,
    ),
)
def encode_ragged_thermometer(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = encode.ragged_thermometer([2, 4, 3, 5], [0.0, 1000.0, 0.0, 0.0], [50.0, 90000.0, 1.0, 1.0])
    return ones_per_bit(tables.line_items(spark, sf_dir), encoder.bits("x"), ["label"])


def percentile_sql(rank: str, bits: int, keys: str = "f") -> str:
    return f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS r,
                  count(*) OVER (PARTITION BY {keys}) AS n FROM xs),
fitted AS (SELECT x.f, k, v AS t FROM ranked x, range({bits}) b(k)
           WHERE x.r = {rank})"""


FLOOR_RANK = "CAST(trunc((k + 1) / CAST({b} AS DOUBLE) * (n - 1)) AS BIGINT)"


@query("fit_percentile", sql.chain(sql.LINES, percentile_sql(FLOOR_RANK.format(b=9), 8), final=THRESHOLDS))
def fit_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_percentile(tables.line_items(spark, sf_dir), "x", 8), spark)


@query(
    "fit_percentile_count",
    sql.chain(sql.LINES, percentile_sql("CAST(trunc(n * (k + 1) / CAST(9 AS DOUBLE)) AS BIGINT)", 8), final=THRESHOLDS),
)
def fit_percentile_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_percentile_count(tables.line_items(spark, sf_dir), "x", 8), spark)


@query(
    "fit_percentile_pooled",
    sql.chain(
        sql.VECTORS,
        "ranked AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS n FROM xs)",
        "fitted AS (SELECT CAST(f AS INTEGER) AS f, k, v AS t FROM ranked, range(4) b(k), range(64) a(f) "
        "WHERE r = CAST(trunc(n * (k + 1) / CAST(5 AS DOUBLE)) AS BIGINT))",
        final=THRESHOLDS,
    ),
)
def fit_percentile_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = encode.fit_percentile_count(tables.vectors(spark, sf_dir), "x", 4, per_feature=False)
    return threshold_rows(encoder, spark)


# The normal quantiles of k/5 and k/8 are constants; SQL has no inverse normal function.
def quantile_values(bits: int) -> str:
    from ..functions.scalars import normal_quantile

    rows = ", ".join(f"({k}, CAST({normal_quantile((k + 1) / (bits + 1))!r} AS DOUBLE))" for k in range(bits))
    return f"(VALUES {rows}) q(k, z)"


STATS = "st AS (SELECT f, avg(v) AS mu, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM xs GROUP BY f)"


@query(
    "fit_gaussian",
    sql.chain(sql.LINES, STATS, f"fitted AS (SELECT f, k, mu + sd * z AS t FROM st, {quantile_values(8)})", final=THRESHOLDS),
)
def fit_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_gaussian(tables.line_items(spark, sf_dir), "x", 8), spark)


@query(
    "fit_gaussian_clamped",
    sql.chain(
        sql.VECTORS, STATS,
        f"fitted AS (SELECT f, k, mu + greatest(sd, 1e-6) * z AS t FROM st, {quantile_values(4)})",
        final=THRESHOLDS,
    ),
)
def fit_gaussian_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_gaussian_clamped(tables.vectors(spark, sf_dir), "x", 4), spark)


@query(
    "fit_exponential",
    sql.chain(
        sql.LINES, STATS,
        "fitted AS (SELECT f, k, CASE WHEN mu > 0 THEN -ln(1 - (k + 1) / CAST(9 AS DOUBLE)) * mu ELSE 0 END AS t FROM st, range(8) b(k))",
        final=THRESHOLDS,
    ),
)
def fit_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_exponential(tables.line_items(spark, sf_dir), "x", 8), spark)


@query(
    "fit_logarithmic",
    sql.chain(
        "xs AS (SELECT 0 AS f, c_acctbal AS v FROM customer)",
        STATS,
        "sh AS (SELECT f, lo, hi, CASE WHEN lo <= 0 THEN 1 - lo ELSE 0 END AS s FROM st)",
        "fitted AS (SELECT f, k, exp(ln(lo + s) + (k + 1) / CAST(9 AS DOUBLE) * (ln(hi + s) - ln(lo + s))) - s AS t FROM sh, range(8) b(k))",
        final=THRESHOLDS,
    ),
)
def fit_logarithmic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "customer").select(F.array("c_acctbal").alias("x"))
    return threshold_rows(encode.fit_logarithmic(rows, "x", 8), spark)


@query(
    "fit_linear",
    sql.chain(
        "xs AS (SELECT 0 AS f, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT 1, p_retailprice FROM part)",
        STATS,
        "fitted AS (SELECT f, k, lo + (k + 1) * (hi - lo) / 6 AS t FROM st, range(5) b(k))",
        final=THRESHOLDS,
    ),
)
def fit_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "part").select(
        F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x")
    )
    return threshold_rows(encode.fit_linear(rows, "x", 5), spark)


@query(
    "fit_class_conditional",
    sql.chain(
        sql.VECTORS,
        "quota AS (SELECT label, 23 // c + CASE WHEN o <= 23 % c THEN 1 ELSE 0 END AS q FROM "
        "(SELECT label, row_number() OVER (ORDER BY label) AS o, count(*) OVER () AS c FROM (SELECT DISTINCT label FROM xs)))",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY f, label ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY f, label) AS n FROM xs)",
        "picked AS (SELECT x.f, v AS t FROM ranked x JOIN quota USING (label), range(23) b(k) "
        "WHERE k < q AND r = CAST(trunc((k + 1) / CAST(q + 1 AS DOUBLE) * (n - 1)) AS BIGINT))",
        "fitted AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY t) - 1 AS k, t FROM picked)",
        final=THRESHOLDS,
    ),
)
def fit_class_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_rows(encode.fit_class_conditional(tables.vectors(spark, sf_dir), "x", "label", 23), spark)


def information_sql(bins: int) -> str:
    return f"""
binned AS (SELECT f, label, (row_number() OVER (PARTITION BY f ORDER BY v, row_id) - 1) * {bins}
                  // count(*) OVER (PARTITION BY f) AS bin FROM xs),
cell AS (SELECT f, bin, label, count(*) AS c FROM binned GROUP BY f, bin, label),
prob AS (SELECT f, c / sum(c) OVER (PARTITION BY f) AS p,
                sum(c) OVER (PARTITION BY f, bin) / sum(c) OVER (PARTITION BY f) AS px,
                sum(c) OVER (PARTITION BY f, label) / sum(c) OVER (PARTITION BY f) AS py FROM cell),
info AS (SELECT f, sum(p * log2(p / (px * py))) AS mi FROM prob GROUP BY f)"""


@query(
    "mutual_information",
    sql.chain(sql.VECTORS, information_sql(8), final="SELECT f AS feature, round(mi, 6) AS mi FROM info"),
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode.mutual_information(tables.vectors(spark, sf_dir), "x", "label", "row_id", 8)
    return found.withColumn("mi", F.round("mi", 6))


@query(
    "fit_mi_allocation",
    sql.chain(
        sql.DOCUMENTS,
        information_sql(8),
        "sc AS (SELECT f, greatest(round(mi, 9), 0) AS mi FROM info)",
        "ex AS (SELECT f, mi / sum(mi) OVER () * 24 AS e FROM sc)",
        "al AS (SELECT f, 2 + CAST(trunc(e) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY e - trunc(e) DESC, f) "
        "<= 24 - sum(trunc(e)) OVER () THEN 1 ELSE 0 END AS q FROM ex)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY f) AS n FROM xs)",
        "fitted AS (SELECT x.f, k, v AS t FROM ranked x JOIN al USING (f), range(32) b(k) "
        "WHERE k < q AND r = CAST(trunc((k + 1) / CAST(q + 1 AS DOUBLE) * (n - 1)) AS BIGINT))",
        final=THRESHOLDS,
    ),
)
def fit_mi_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return threshold_rows(encode.fit_mi_allocation(docs, "x", "label", "row_id", 8, 2), spark)


@query(
    "fit_entropy_weighted",
    sql.chain(
        sql.DOCUMENTS,
        "rk AS (SELECT f, label, v, row_number() OVER (PARTITION BY f ORDER BY v, row_id) - 1 AS i, count(*) OVER (PARTITION BY f) AS n FROM xs)",
        "wn AS (SELECT *, least(greatest(10, CAST(floor(sqrt(n)) AS BIGINT)), n // 4) AS w FROM rk)",
        "sp AS (SELECT *, greatest(i - w // 2, 0) AS lo0, least(n, i + w // 2 + 1) AS hi0 FROM wn)",
        "sp2 AS (SELECT f, i, v, CASE WHEN hi0 - lo0 > w AND lo0 <> 0 THEN hi0 - w ELSE lo0 END AS lo, "
        "CASE WHEN hi0 - lo0 > w AND lo0 = 0 THEN w ELSE hi0 END AS hi FROM sp)",
        "cn AS (SELECT s.f, s.i, s.hi - s.lo AS z, r.label, count(*) AS c FROM sp2 s JOIN rk r ON r.f = s.f AND r.i >= s.lo AND r.i < s.hi "
        "GROUP BY s.f, s.i, s.hi - s.lo, r.label)",
        "en AS (SELECT f, i, -sum(c / CAST(z AS DOUBLE) * log2(c / CAST(z AS DOUBLE))) AS e FROM cn GROUP BY f, i)",
        "we AS (SELECT f, i, e + CASE WHEN max(e) OVER (PARTITION BY f) > 0 THEN 0.01 * max(e) OVER (PARTITION BY f) ELSE 1 END AS w FROM en)",
        "cu AS (SELECT f, i, sum(w) OVER (PARTITION BY f ORDER BY i) AS c, sum(w) OVER (PARTITION BY f) AS total FROM we)",
        "pk AS (SELECT f, k, min(i) AS i FROM cu, range(8) b(k) WHERE c >= (k + 1) / CAST(9 AS DOUBLE) * total GROUP BY f, k)",
        "fitted AS (SELECT pk.f, k, v AS t FROM pk JOIN rk ON rk.f = pk.f AND rk.i = pk.i)",
        final=THRESHOLDS,
    ),
)
def fit_entropy_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir)
    return threshold_rows(encode.fit_entropy_weighted(docs, "x", "label", "row_id", 8), spark)


@query(
    "encode_percentile",
    sql.chain(
        sql.VECTORS,
        percentile_sql(FLOOR_RANK.format(b=5), 4),
        sql.bits_from("SELECT f, k, t FROM fitted"),
        final=BIT_TEXT,
    ),
)
def encode_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    encoder = encode.fit_percentile(rows, "x", 4)
    return rows.select("row_id", F.array_join(encoder.bits("x"), "").alias("bits"))


@query(
    "order_statistics",
    """SELECT o_orderpriority, k, o_totalprice AS value FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r,
               count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), range(10) b(k)
       WHERE r = k * (n - 1) // 9""",
)
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice")
    found = order.order_statistics(
        orders, ["o_orderpriority"], "o_totalprice", lambda _key, n: [k * (n - 1) // 9 for k in range(10)]
    )
    rows = [(key[0], k, s.value) for key, stats in found.items() for k, s in enumerate(stats)]
    return spark.createDataFrame(rows, "o_orderpriority string, k bigint, value double")


@query(
    "global_ranks",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS "rank"
       FROM events""",
)
def global_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return order.global_ranks(events, ["event_type"], "value", "event_id", 16).select(
        "event_type", "event_id", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "encode_circular",
    sql.chain(
        sql.EVENT_POINTS,
        "bits AS (SELECT row_id, i, CASE WHEN least(abs(hour - i / CAST(8 AS DOUBLE) * 24), 24 - abs(hour - i / CAST(8 AS DOUBLE) * 24)) < 6 THEN 1 ELSE 0 END AS b FROM ev, range(8) t(i))",
        final=BIT_TEXT,
    ),
)
def encode_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.event_points(spark, sf_dir)
    bits = encode.circular_bits(F.array("hour"), 8, 0.0, 24.0)
    return rows.select("row_id", F.array_join(bits, "").alias("bits"))


PIXELS = """
px AS (SELECT p_partkey AS image_id, CAST(p AS INTEGER) AS p, md5(p_partkey || ':' || p) AS d FROM part, range(16) t(p)),
rgb AS (SELECT image_id, p, ('0x' || substr(d, 1, 2))::INTEGER / 255.0::DOUBLE AS r,
               ('0x' || substr(d, 3, 2))::INTEGER / 255.0::DOUBLE AS g, ('0x' || substr(d, 5, 2))::INTEGER / 255.0::DOUBLE AS b FROM px),
masks AS (SELECT image_id, p, CASE WHEN r > 0.5::DOUBLE AND r - g > 0.1::DOUBLE AND r - b > 0.1::DOUBLE THEN 1 ELSE 0 END AS red,
                 CASE WHEN r > 0.75::DOUBLE AND g > 0.75::DOUBLE AND b > 0.75::DOUBLE THEN 1 ELSE 0 END AS white,
                 CASE WHEN r < 0.2::DOUBLE AND g < 0.2::DOUBLE AND b < 0.2::DOUBLE THEN 1 ELSE 0 END AS dark FROM rgb)"""


@query(
    "encode_color_masks",
    sql.chain(
        PIXELS,
        final="SELECT image_id, CAST(sum(red) AS BIGINT) AS red, CAST(sum(white) AS BIGINT) AS white, CAST(sum(dark) AS BIGINT) AS dark FROM masks GROUP BY image_id",
    ),
)
def encode_color_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = tables.pixels(spark, sf_dir)
    masks = encode.color_masks(F.col("r"), F.col("g"), F.col("b"))
    return px.select("image_id", *masks).groupBy("image_id").agg(
        *[F.sum(m).alias(m) for m in ("red", "white", "dark")]
    )


def kernels_sql(dim: int) -> str:
    return (
        f"kern AS (SELECT CAST(i AS INTEGER) AS kernel, CAST(d AS INTEGER) AS d, 2 * (('0x' || substr(md5('kernel:5:' || i || ':' || d), 1, 12))::BIGINT "
        f"/ CAST(281474976710656 AS DOUBLE)) - 1 AS c FROM range(24) a(i), range({dim}) b(d))"
    )


CANVAS_END = [
    "dist AS (SELECT user_id, row_id, kernel, sqrt(sum((z - c) * (z - c))) AS dd FROM pts JOIN kern USING (d) GROUP BY user_id, row_id, kernel)",
    "near AS (SELECT DISTINCT user_id, kernel FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY dd, kernel) AS r FROM dist) WHERE r <= 2)",
    "bits AS (SELECT u.user_id, k.kernel, CASE WHEN n.kernel IS NULL THEN '000' ELSE '111' END AS b FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN "
    "(SELECT CAST(i AS INTEGER) AS kernel FROM range(24) t(i)) k LEFT JOIN near n ON n.user_id = u.user_id AND n.kernel = k.kernel)",
]
CANVAS_FINAL = "SELECT user_id, string_agg(b, '' ORDER BY kernel) AS bits FROM bits GROUP BY user_id"
SQUASHED = (
    "sq AS (SELECT user_id, row_id, ts, tanh((avg(value) OVER u - value) / stddev_pop(value) OVER u) AS z0, "
    "tanh((avg(hour) OVER u - hour) / stddev_pop(hour) OVER u) AS z1 FROM ev WINDOW u AS (PARTITION BY user_id))"
)


@query(
    "kernel_canvas",
    sql.chain(
        sql.EVENT_POINTS,
        kernels_sql(2),
        SQUASHED,
        "pts AS (SELECT user_id, row_id, 0 AS d, z0 AS z FROM sq UNION ALL SELECT user_id, row_id, 1, z1 FROM sq)",
        *CANVAS_END,
        final=CANVAS_FINAL,
    ),
)
def kernel_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.event_points(spark, sf_dir)
    points = encode.squashed_points(events, "user_id", "row_id", ["value", "hour"])
    canvas = encode.kernel_canvas(points, "user_id", encode.kernel_table(24, 2, 5), 3, 0.07)
    return canvas.select("user_id", F.array_join("bits", "").alias("bits"))


@query(
    "kernel_canvas_direction",
    sql.chain(
        sql.EVENT_POINTS,
        kernels_sql(4),
        SQUASHED,
        "st AS (SELECT *, lead(z0) OVER w - z0 AS d0, lead(z1) OVER w - z1 AS d1 FROM sq WINDOW w AS (PARTITION BY user_id ORDER BY row_id))",
        "un AS (SELECT *, CASE WHEN sqrt(d0 * d0 + d1 * d1) > 0 THEN d0 / sqrt(d0 * d0 + d1 * d1) WHEN d0 IS NOT NULL THEN 0 END AS u0, "
        "CASE WHEN sqrt(d0 * d0 + d1 * d1) > 0 THEN d1 / sqrt(d0 * d0 + d1 * d1) WHEN d0 IS NOT NULL THEN 0 END AS u1 FROM st)",
        "fi AS (SELECT user_id, row_id, z0, z1, coalesce(u0, lag(u0) OVER w, 0) AS u0, coalesce(u1, lag(u1) OVER w, 0) AS u1 FROM un "
        "WINDOW w AS (PARTITION BY user_id ORDER BY row_id))",
        "pts AS (SELECT user_id, row_id, 0 AS d, z0 AS z FROM fi UNION ALL SELECT user_id, row_id, 1, z1 FROM fi "
        "UNION ALL SELECT user_id, row_id, 2, u0 FROM fi UNION ALL SELECT user_id, row_id, 3, u1 FROM fi)",
        *CANVAS_END,
        final=CANVAS_FINAL,
    ),
)
def kernel_canvas_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.event_points(spark, sf_dir)
    bucket = F.floor(F.col("row_id") / 256)  # event numbers follow time
    points = encode.squashed_points(events, "user_id", "row_id", ["value", "hour"], bucket)
    canvas = encode.kernel_canvas(points, "user_id", encode.kernel_table(24, 4, 5), 3, 0.07)
    return canvas.select("user_id", F.array_join("bits", "").alias("bits"))


@query(
    "concat_and_edit_bits",
    sql.chain(
        sql.VECTORS,
        "bits AS (SELECT row_id, f AS i, CASE WHEN v >= 0 THEN 1 ELSE 0 END AS b FROM xs "
        "UNION ALL SELECT row_id, 64 + f, CASE WHEN f = 3 THEN 1 WHEN v >= 0.1::DOUBLE THEN 1 ELSE 0 END FROM xs)",
        final="SELECT row_id, string_agg(b, '' ORDER BY i) AS bits, max(CASE WHEN i = 70 THEN b END) AS bit70 FROM bits GROUP BY row_id",
    ),
)
def concat_and_edit_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select(
        "row_id",
        encode.constant_threshold("x", 0.0).alias("a"),
        encode.constant_threshold("x", 0.1).alias("b"),
    )
    joined = rows.select("row_id", "a", encode.set_bit("b", 3, 1).alias("b")).select(
        "row_id", encode.concat_bits("a", "b").alias("bits")
    )
    return joined.select(
        "row_id",
        F.array_join("bits", "").alias("bits"),
        encode.get_bit("bits", 70).cast("int").alias("bit70"),
    )


@query(
    "packed_bits",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS,
        "packs AS (SELECT row_id, i // 8 AS place, CAST(sum(b << (7 - i % 8)) AS BIGINT) AS n FROM bits GROUP BY row_id, i // 8)",
        final="SELECT row_id, '00' || string_agg(upper(printf('%02x', n)), '' ORDER BY place) AS packed, "
        "true AS same FROM packs GROUP BY row_id",
    ),
)
def packed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("row_id", VECTOR_BITS.bits("x").alias("bits"))
    packed = rows.select("row_id", "bits", pack_bits(F.col("bits")).alias("data"))
    return packed.select(
        "row_id", F.hex("data").alias("packed"), (unpack_bits(F.col("data")) == F.col("bits")).alias("same")
    )


@query(
    "feature_statistics",
    sql.chain(
        sql.VECTORS,
        final="SELECT f AS feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max, count(v) AS n FROM xs GROUP BY f",
    ),
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = encode.feature_statistics(tables.vectors(spark, sf_dir), "x")
    found = spark.createDataFrame(
        [tuple(s) for s in stats], "feature int, mean double, std double, min double, max double, n bigint"
    )
    return found.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


# -- addresses ---------------------------------------------------------------

ADDRESS_ROWS = "SELECT row_id, ram AS ram_id, a AS address FROM addr"
VECTOR_LABELS = "SELECT DISTINCT label FROM xs"


@query(
    "addresses_shared",
    sql.chain(sql.VECTORS, sql.VECTOR_BITS, sql.shared_mapping(128, 8, 7), sql.ADDRESSES, final=ADDRESS_ROWS),
)
def addresses_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.random_mapping(128, 8, 7)
    return address.tuple_rows(tables.vectors(spark, sf_dir), mapping, VECTOR_BITS.on("x"), ["row_id"])


@query(
    "addresses_in_row",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS, sql.shared_mapping(128, 8, 7), sql.ADDRESSES,
        final="SELECT row_id, string_agg(a, ',' ORDER BY ram) AS addresses FROM addr GROUP BY row_id",
    ),
)
def addresses_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.random_mapping(128, 8, 7)
    rows = tables.vectors(spark, sf_dir)
    found = address.tuple_addresses(mapping, VECTOR_BITS.on("x"))
    return rows.select("row_id", F.array_join(found.cast("array<string>"), ",").alias("addresses"))


def labelled_addresses(spark: SparkSession, sf_dir: str, size: int, complete: bool) -> DataFrame:
    rows = tables.vectors(spark, sf_dir)
    labels = sorted(r[0] for r in rows.select("label").distinct().collect())
    mapping = address.random_mapping(128, size, 7, labels, complete)
    return address.tuple_rows(rows, mapping, VECTOR_BITS.on("x"), ["row_id"])


FAN_OUT = "SELECT row_id, label, ram AS ram_id, a AS address FROM own"


@query(
    "addresses_per_label_padded",
    sql.chain(sql.VECTORS, sql.VECTOR_BITS, sql.label_mapping(128, 7, 7, VECTOR_LABELS), sql.LABEL_CLASSIFIER, final=FAN_OUT),
)
def addresses_per_label_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_addresses(spark, sf_dir, 7, True)


@query(
    "addresses_per_label_cut",
    sql.chain(sql.VECTORS, sql.VECTOR_BITS, sql.label_mapping(128, 12, 7, VECTOR_LABELS, False), sql.LABEL_CLASSIFIER, final=FAN_OUT),
)
def addresses_per_label_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_addresses(spark, sf_dir, 12, False)


MULTI_MAP = """
sz0 AS (SELECT i, CAST(floor(4 + i / CAST(15 AS DOUBLE) * 8 + 0.5) AS BIGINT) AS s FROM range(16) t(i)),
tot AS (SELECT 128 - sum(s) AS d FROM sz0),
sz AS (SELECT i, s + CASE WHEN d >= 0 THEN d // 16 + CASE WHEN i >= 16 - d % 16 THEN 1 ELSE 0 END ELSE 0 END AS s FROM sz0, tot),
so AS (SELECT s, row_number() OVER (ORDER BY md5('7:size:' || i)) - 1 AS ram FROM sz),
cum AS (SELECT CAST(ram AS INTEGER) AS ram, s, sum(s) OVER (ORDER BY ram) - s AS start FROM so),
ordr AS (SELECT CAST(i AS INTEGER) AS i, row_number() OVER (ORDER BY md5('7:' || i)) - 1 AS rn FROM range(128) t(i)),
map AS (SELECT c.ram, CAST(o.rn - c.start AS INTEGER) AS pos, o.i FROM ordr o JOIN cum c ON o.rn >= c.start AND o.rn < c.start + c.s)"""


@query("addresses_multi_resolution", sql.chain(sql.VECTORS, sql.VECTOR_BITS, MULTI_MAP, sql.ADDRESSES, final=ADDRESS_ROWS))
def addresses_multi_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.multi_resolution_mapping(128, 8, 7)
    return address.tuple_rows(tables.vectors(spark, sf_dir), mapping, VECTOR_BITS.on("x"), ["row_id"])


@query(
    "addresses_local_windows",
    sql.chain(
        PIXELS,
        "bits AS (SELECT image_id AS row_id, '' AS label, p * 3 + k AS i, CASE k WHEN 0 THEN red WHEN 1 THEN white ELSE dark END AS b FROM masks, range(3) t(k))",
        "win AS (SELECT CAST((top * 2 + lft) * 2 + r AS INTEGER) AS ram, ((top * 2 + dh) * 4 + lft * 2 + dw) * 3 + k AS i "
        "FROM range(2) a(top), range(2) b(lft), range(2) c(r), range(2) d(dh), range(2) e(dw), range(3) g(k))",
        "map AS (SELECT ram, CAST(i AS INTEGER) AS i, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY ram ORDER BY md5('3:' || ram || ':' || i)) - 1 AS pos FROM win) WHERE pos < 6)",
        sql.ADDRESSES,
        final=ADDRESS_ROWS,
    ),
)
def addresses_local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = tables.pixels(spark, sf_dir)
    masks = encode.color_masks(F.col("r"), F.col("g"), F.col("b"))
    flat = F.flatten(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "bits"))), lambda s: s["bits"])
    )
    images = (
        px.select("image_id", (F.col("row") * 4 + F.col("col")).alias("place"), F.array(*masks).alias("bits"))
        .groupBy(F.col("image_id").alias("row_id"))
        .agg(flat.alias("bits"))
    )
    mapping = address.local_2d_mapping(4, 4, 3, 2, 2, 6, 3, rams_per_window=2)
    return address.tuple_rows(images, mapping, address.BitColumn("bits"), ["row_id"])


@query(
    "addresses_wide",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS, sql.shared_mapping(128, 64, 7),
        final="SELECT row_id, ram AS ram_id, string_agg(b, '' ORDER BY pos) AS address FROM bits JOIN map USING (i) GROUP BY row_id, ram",
    ),
)
def addresses_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.random_mapping(128, 64, 7)
    return address.tuple_rows(tables.vectors(spark, sf_dir), mapping, VECTOR_BITS.on("x"), ["row_id"])


@query(
    "addresses_base4",
    sql.chain(
        sql.VECTORS,
        "bits AS (SELECT row_id, label, f AS i, CAST((v > -0.1::DOUBLE)::INT + (v > 0)::INT + (v > 0.1::DOUBLE)::INT AS BIGINT) AS b FROM xs)",
        sql.shared_mapping(64, 4, 9),
        "addr AS (SELECT row_id, ram, CAST(sum(b * (1 << (2 * pos))) AS BIGINT) AS a FROM bits JOIN map USING (i) GROUP BY row_id, ram)",
        final=ADDRESS_ROWS,
    ),
)
def addresses_base4(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.transform(
        "x",
        lambda v: sum((F.when(v > t, 1).otherwise(0) for t in (-0.1, 0.0, 0.1)), F.lit(0)).cast("tinyint"),
    )
    rows = tables.vectors(spark, sf_dir).select("row_id", levels.alias("digits"))
    mapping = address.random_mapping(64, 4, 9, base=4)
    return address.tuple_rows(rows, mapping, address.BitColumn("digits"), ["row_id"])


@query(
    "addresses_ordered",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS,
        "map AS (SELECT CAST(i AS INTEGER) AS i, CAST(i // 8 AS INTEGER) AS ram, CAST(i % 8 AS INTEGER) AS pos FROM range(128) t(i))",
        sql.ADDRESSES, final=ADDRESS_ROWS,
    ),
)
def addresses_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.ordered_mapping(128, 8)
    return address.tuple_rows(tables.vectors(spark, sf_dir), mapping, VECTOR_BITS.on("x"), ["row_id"])


@query(
    "addresses_explicit",
    sql.chain(
        sql.VECTORS, sql.VECTOR_BITS,
        "map AS (SELECT CAST(ram AS INTEGER) AS ram, CAST(pos AS INTEGER) AS pos, CAST(pos * 16 + ram AS INTEGER) AS i FROM range(16) a(ram), range(8) b(pos))",
        sql.ADDRESSES, final=ADDRESS_ROWS,
    ),
)
def addresses_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = address.explicit_mapping(128, [[p * 16 + r for p in range(8)] for r in range(16)])
    return address.tuple_rows(tables.vectors(spark, sf_dir), mapping, VECTOR_BITS.on("x"), ["row_id"])
