"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Native: DataFrame functions only.  The tokens of each source are dealt to shards, laid out in a
seeded order of the documents and cut into blocks of equal size.  Blocks are the seats: sources get
them by the highest quotients of their targets, the shards of a source by the highest quotients of
what they hold.  A shard takes all its blocks as often as its quota holds them, and the rest as a
run of blocks from a seeded one on; behind the last block, which is shorter, the run goes on at the
first, until it has as many tokens as the quota asks for.  The order of the documents is seeded too,
so a run is a seeded choice of whole documents but for its two ends.

The size of a block is the same for all sources: a 2^18th of the input, but small enough for
every source to be aimed at by 128 blocks, so that rounding to blocks moves no source far from its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, hex_number, seeded, stored

#: A block holds about so many tokens, and one more for each 2^18 tokens of the whole input.
LEAST_BLOCK = 64
BLOCKS = 1 << 18
#: The target of the smallest source is at least so many blocks (or blocks are single tokens).
SOURCE_BLOCKS = 128
#: Documents of a shard, about; shards bound the rows that one ordered pass sees.
SHARD_DOCS = 50_000


def cyclic_weights(source: str = "source") -> Column:
    """1, 2, 3, repeating, over the sources in order of their code points, null last."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    return ((place - 1) % 3 + 1).cast("double")


def targets(sources: DataFrame, max_repeats: int) -> DataFrame:
    """Add ``target``: shares of all sizes by ``weight``, none above ``max_repeats`` its size.

    ``sources`` has a row for each source: ``size`` and ``weight``.  Sources in order of the
    level at which they fill up: below the common level a source gives all it may, above it the
    level times its weight.
    """
    order = Window.orderBy("_full", "sid")
    full = sources.withColumn("_cap", F.col("size") * F.lit(float(max_repeats)))
    full = full.withColumn("_full", F.col("_cap") / F.col("weight"))
    levelled = full.withColumns(
        {
            "_given": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_rest": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "_all": F.sum("size").over(Window.partitionBy()).cast("double"),
        }
    ).withColumn("_level", (F.col("_all") - F.col("_given")) / F.col("_rest"))
    fits = F.when(F.col("_full") >= F.col("_level"), F.struct("_full", "sid", "_level"))
    level = F.min(fits).over(Window.partitionBy())["_level"]
    return levelled.withColumn("target", F.least("_cap", level * F.col("weight"))).drop(
        "_cap", "_full", "_given", "_rest", "_all", "_level"
    )


def sainte_lague(df: DataFrame, by: list[str], weight: str, seats: str, tie: list[str], name: str) -> DataFrame:
    """Add the seats that each row gets of the ``seats`` of its group, by the highest quotients.

    The quotients of a row are weight / 1, weight / 3, weight / 5 and so on; a group's seats go
    to its highest quotients, ties in order of ``tie``.  The last quotient that gets a seat lies
    between the two divisors that round to too many and to too few seats for any weights, so
    only the few seats of each row between the two are compared one by one.
    """
    group = Window.partitionBy(*by)
    some = df.where((F.col(weight) > 0) & (F.col(seats) > 0)).withColumns(
        {"_sum": F.sum(weight).over(group), "_rows": F.count(F.lit(1)).over(group)}
    )
    fewer = F.greatest((F.col(seats) - F.col("_rows") / 2) / F.col("_sum"), F.lit(0.0))
    more = (F.col(seats) + F.col("_rows") / 2) / F.col("_sum")
    bounds = some.withColumns(
        {
            "_low": F.greatest(F.floor(F.col(weight) * fewer + 0.5) - 1, F.lit(0)),
            "_high": F.floor(F.col(weight) * more + 0.5) + 1,
        }
    )
    open_seats = bounds.withColumn("_open", F.col(seats) - F.sum("_low").over(group)).withColumn(
        "_k", F.explode(F.sequence("_low", "_high"))
    )
    highest = Window.partitionBy(*by).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *tie, "_k")
    won = open_seats.withColumn("_place", F.row_number().over(highest))
    own = [c for c in df.columns]
    return won.groupBy(*own).agg(
        (F.first("_low") + F.count(F.when(F.col("_place") <= F.col("_open"), 1))).cast("long").alias(name)
    )


def block_size(total: int, least_target: float | None) -> int:
    return max(1, min(LEAST_BLOCK + total // BLOCKS, int((least_target or 0) // SOURCE_BLOCKS)))


def dealt_out(shards: DataFrame, block: int, max_repeats: int, seed: int) -> DataFrame:
    """How each shard is taken: ``whole`` times, and ``rest`` tokens more from ``first`` on.

    ``shards``: ``sid``, ``shard``, ``held`` (tokens) and ``quota`` (blocks).
    """
    tokens = F.least(F.col("quota") * block, max_repeats * F.col("held"))
    drawn = hex_number(seeded(seed, "sid", "shard"), 13) % F.ceil(F.col("held") / block)
    return shards.withColumn("_tokens", tokens).select(
        "sid", "shard", "held",
        F.floor(F.col("_tokens") / F.col("held")).cast("int").alias("whole"),
        (F.col("_tokens") % F.col("held")).alias("rest"),
        (drawn * block).alias("first"),
    )


def run_parts() -> Column:
    """Which tokens of a document (``start``, ``size``) lie in the run of its shard; at most two pieces."""
    end = F.col("first") + F.col("rest")
    upto = F.col("start") + F.col("size")
    begin = F.greatest("first", "start")
    pieces = F.array(
        # Behind the last block the run goes on at the first.
        F.struct(F.lit(0).cast("long").alias("first"), (F.least(end - F.col("held"), upto) - F.col("start")).alias("length")),
        F.struct((begin - F.col("start")).alias("first"), (F.least(end, F.col("held"), upto) - begin).alias("length")),
    )
    return F.filter(pieces, lambda p: p["length"] > 0)


def mix(
    docs: DataFrame,
    size: Column,
    *,
    keep: list[str] = ("doc_id",),
    source: str = "source",
    weight: Column | None = None,
    max_repeats: int = 3,
    seed: int = 10,
    draw_by: list[str] | None = None,
) -> DataFrame:
    """What a mixture takes of each document.

    Returns the ``keep`` columns and ``size``, ``source_size``, ``target`` (of the source),
    ``taken``, ``whole`` (times the whole document is taken) and ``parts`` (ranges of tokens
    ``first``, ``length`` that are taken once more).  ``weight`` is an expression over one row
    for each source (default: :func:`cyclic_weights`).  The draw depends on the seed
    and on the ``draw_by`` columns (default: ``keep``), so reruns agree.

    Null sources form one source, the last.  Null sizes count 0; documents of size 0 take
    nothing.  Rows that repeat, ids included, are documents of their own.  No rows give no
    rows.  Other columns, whatever their names, are not read.
    """
    draw = seeded(seed, *(draw_by or keep))
    base = stored(
        docs.select(
            *[F.col(c).alias(f"k_{c}") for c in keep],
            F.col(source).alias("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            draw.alias("draw"),
        )
    )
    sources = base.groupBy("source").agg(
        F.sum("size").alias("size"), (1 + F.floor(F.count(F.lit(1)) / SHARD_DOCS)).alias("shards")
    ).withColumns(
        {
            "sid": F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())),
            "weight": cyclic_weights() if weight is None else weight.cast("double"),
        }
    )
    aimed = stored(targets(sources, max_repeats))
    counted = aimed.agg(F.sum("size").alias("all"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = block_size(counted["all"] or 0, counted["least"])
    seats = F.floor(F.sum("size").over(Window.partitionBy()) / block + 0.5).cast("long")
    quotas = stored(
        sainte_lague(aimed.withColumn("seats", seats), [], "target", "seats", ["sid"], "blocks")
        .select("sid", "blocks")
        .join(aimed.select("sid", "source", "shards", "target", F.col("size").alias("source_size")), "sid", "right")
        .fillna(0, ["blocks"])
    )

    placed = base.join(quotas.select("sid", "source", "shards", "target", "source_size"), base["source"].eqNullSafe(quotas["source"])).select(
        *[f"k_{c}" for c in keep], "sid", "target", "source_size", "size", "draw",
        (hex_number("draw") % F.col("shards")).alias("shard"),
    )
    held = stored(placed.groupBy("sid", "shard").agg(F.sum("size").alias("held")).where("held > 0"))
    seated = sainte_lague(held.join(quotas.select("sid", "blocks"), "sid"), ["sid"], "held", "blocks", ["shard"], "quota")
    quota = held.join(seated.select("sid", "shard", "quota"), ["sid", "shard"], "left").fillna(0, ["quota"])
    dealt = dealt_out(quota, block, max_repeats, seed)

    laid = (
        Window.partitionBy("sid", "shard")
        .orderBy("draw", *[f"k_{c}" for c in keep], "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lined = placed.withColumn("start", F.coalesce(F.sum("size").over(laid), F.lit(0)))
    # The table of shards is partitioned like the window.
    out = lined.join(dealt, ["sid", "shard"], "left").withColumn("parts", run_parts())
    extra = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    whole = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0))).otherwise(0)
    none = F.array().cast("array<struct<first:bigint,length:bigint>>")
    return out.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "size", "source_size", "target",
        (whole * F.col("size") + F.coalesce(extra, F.lit(0).cast("long"))).cast("long").alias("taken"),
        whole.alias("whole"),
        F.coalesce("parts", none).alias("parts"),
    )


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The texts of a mixture: ``whole`` copies of a document and a row for each of its parts.

    Words keep the white space behind them.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = bound(
        words,
        lambda known: F.transform(
            "parts", lambda p: F.array_join(F.slice(known, (p["first"] + 1).cast("int"), p["length"].cast("int")), "")
        ),
    )
    rows = F.concat(F.array_repeat(F.col(text), F.col("whole")), F.when(F.size("parts") > 0, cut).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn(text, F.explode(rows)).drop("whole", "parts")
