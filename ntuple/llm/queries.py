"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    divergence,
    fingerprints,
    linededup,
    mixing,
    nearjoin,
    negatives,
    packing,
    quality,
    secrets,
    sharding,
    simhash,
    urlfilter,
)
from .common import count_words, running, stored, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts.

    Documents are numbered by ``doc_id``; each sends the head of its text to the one before it.
    The texts are shuffled once, by the row of the file they come from, and once their heads.
    """
    docs = linededup.with_row_id(table(spark, sf_dir, "documents").select("doc_id", "text"))
    row = ["_file", "_row"]
    texts = docs.select(*row, F.coalesce("text", F.lit("")).alias("text"))
    sizes = docs.select("doc_id", *row, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    numbered = stored(running(sizes, ["doc_id", *row], None, "place"))
    n = numbered.count()
    before = numbered.select(
        ((F.col("place") + 1) % F.lit(max(n, 1))).alias("place"),
        F.col("_file").alias("p_file"), F.col("_row").alias("p_row"), F.floor(F.col("n_chars") / 2).alias("need"),
    )
    links = stored(numbered.select("place", *row).join(before, "place").drop("place"))
    heads = texts.join(links, row).select(
        F.col("p_file").alias("_file"), F.col("p_row").alias("_row"), "need",
        F.substr("text", F.lit(1), F.col("need").cast("int")).alias("head"),
    )
    edited = F.concat(F.substr("text", F.lit(1), (F.length("text") - F.col("need")).cast("int")), F.col("head"))
    pairs = texts.join(heads, row).select(*row, "text", edited.alias("edited"))
    both = pairs.select(*row, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    signed = fingerprints.fingerprints(both, [*row, "which"])
    digests = pairs.select(*row, F.sha2("edited", 256).alias("edited_sha256"))
    own = signed.groupBy(*row).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    rows = stored(numbered.join(own, row).join(digests, row).drop(*row))
    following = rows.select(((F.col("place") + n - 1) % F.lit(max(n, 1))).alias("place"), F.col("fingerprint").alias("next"))
    return rows.join(following, "place").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        fingerprints.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        fingerprints.likeness("fingerprint", "next").alias("near_next"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


#: The rules of the page filter.
URL_RULES = [
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urlfilter.fit(urlfilter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES, model).drop("score")


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.with_row_id(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return nearjoin.near_classes(docs).select("doc_id", "class_id", "n_links")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, r.kind)) for r in secrets.BASE]
    counts = [(F.size("spans") - n).cast("long").alias(f"n_{r.kind}") for n, r in zip(counts, secrets.BASE, strict=True)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; runs are written ``start-end``, comma-joined."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"], r["end"])), ",")
    return out.select("doc_id", "text", "n_lines", "deleted_lines", runs.alias("runs"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal bytes.  The dimensions come from the text alone: equal texts stay together."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("bytes"),
        F.length(text).alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).alias("spaces"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("tie"),
    )
    size = F.col("bytes") + 8
    dims = [F.log2(size), F.col("chars") / F.greatest("bytes", F.lit(1)), F.col("spaces") / F.greatest("chars", F.lit(1))]
    out = sharding.kd_shards(docs, dims, F.col("tie"), size, SHARDS, keep=["doc_id", "text_crc32"])
    return out.select(
        "doc_id", F.col("weight").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, read back from the output.

    Conversations are records of all layouts that can hold them, dealt by ``conv_id``.
    """
    hard = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    rows = rows.unionByName(more)
    shown = chat.render(chat.conversation_turns(rows, chat.dealt_layout))
    back = shown.withColumns({"back": chat.read_back(F.col("formatted")), "learned": chat.learned()})
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"))
    return mixing.mix(docs, F.col("size")).drop("whole", "parts")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th vector is an anchor; every 7th changes its label first."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, id="vec_id", vector="embedding", label=label, anchors=F.col("vec_id") % 50 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES: dict[str, Query] = {
    "op1_curve_packing": op1_curve_packing,
    "op2_weighted_fingerprints": op2_weighted_fingerprints,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_near_join": op5_near_join,
    "op6_secret_scan": op6_secret_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_kd_shards": op8_kd_shards,
    "op9_chat_turns": op9_chat_turns,
    "op10_mix_sources": op10_mix_sources,
    "op11_source_audit": op11_source_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash": op13_simhash,
}
