"""A corpus in five stages: from raw documents to packed training sequences.

Every stage reads what the one before it has written as Parquet, and all but the last return the
columns of ``documents``.

In all stages a null text counts as an empty one, rows that repeat are documents of their own,
no rows give no rows, and other columns, whatever their names, keep their values.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ntuple.llm import linededup, mixing, nearjoin, packing, quality
from ntuple.llm.common import count_words, stored, table
from ntuple.llm.queries import tokenizer_path

#: Two stages count, compare or sample with hashes of their own, which SQL does not have.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The columns that stages read or change.
USED = ("doc_id", "text", "source", "n_chars")


def shielded(stage: Stage) -> Stage:
    """Other columns have numbers for names inside the stage, so that none clashes with what operators add."""

    @functools.wraps(stage)
    def run_shielded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in USED else f"extra column {i}" for i, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run_shielded


@shielded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the rules keep; empty texts fail, documents of the same text share their verdict."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


@shielded
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document of which no word is left goes.

    Of equal runs the one of the smallest id stays; texts without a repeated run stay as they are.
    """
    cut = linededup.dedup_lines(docs)
    changed = F.col("deleted_lines") > 0
    return (
        cut.where(~changed | (count_words(F.col("text")) > 0))
        .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


@shielded
def near_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; all texts without words are one class."""
    rows = linededup.with_row_id(docs)
    first = nearjoin.near_classes(rows).where("first").select("_file", "_row")
    return rows.join(first, ["_file", "_row"], "left_semi").select(*docs.columns)


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: whole documents, up to three times, and parts of documents.

    Documents without words are not taken; documents without a source are a source of their own.
    """
    rows = linededup.with_row_id(docs)
    mixed = mixing.mix(
        rows.select("doc_id", "source", "_file", "_row", count_words(F.col("text")).alias("size")),
        F.col("size"),
        keep=["doc_id", "_file", "_row"],
        draw_by=["doc_id"],
    )
    taken = mixed.where("taken > 0").select("_file", "_row", "whole", "parts")
    texts = mixing.copies(rows.join(taken, ["_file", "_row"]))
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, neighbours on the curve together."""
    return packing.pack(docs, tokenizer_path(), remember=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_join),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_curve),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
