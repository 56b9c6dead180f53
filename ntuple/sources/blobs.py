"""Readers for base64 text formats: saved datasets and memory contents.

Files are split by Spark (``.`` ends a record), fields by column expressions; only the
fixed-width little-endian numbers are decoded by vectorised Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import unpack_bits

# Layouts of one memory entry.
COUNT_ENTRY = np.dtype([("address", "<u8"), ("cnt", "<i4")])
REGRESSION_ENTRY = np.dtype([("address", "<u8"), ("cnt", "<f8"), ("sum_y", "<f8"), ("pending", "<f8")])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Saved bit rows ``(bits, label, y)``.

    Records are ``label#bits`` in base64; the first one of a file carries the header, which
    names the kind: ``C$`` text labels, ``R$`` double targets, ``U$`` neither.
    """
    header = r"^([CRU])\$"
    records = spark.read.option("lineSep", ".").text(path)
    kinds = [
        r[0]
        for r in records.where(F.col("value").rlike(header))
        .select(F.regexp_extract("value", header, 1))
        .distinct()
        .collect()
    ]
    if len(kinds) != 1:
        raise ValueError("the files need one common kind of header")
    fields = F.split(F.trim(F.regexp_replace("value", header, "")), "#")
    rows = records.select(fields.alias("f")).where(F.size("f") == 2).select(
        unpack_bits(F.unbase64(F.get("f", F.lit(1)))).alias("bits"),
        F.when(F.length(F.get("f", F.lit(0))) > 0, F.unbase64(F.get("f", F.lit(0)))).alias("_l"),
    )
    if kinds[0] == "R":
        return _doubles(rows)
    return rows.select(
        "bits", F.col("_l").cast("string").alias("label"), F.lit(None).cast("double").alias("y")
    )


def _doubles(rows: DataFrame) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = [None if v is None else float(np.frombuffer(v, "<f8")[0]) for v in pdf["_l"]]
            yield pd.DataFrame({"bits": pdf["bits"], "label": None, "y": y})

    return rows.mapInPandas(decode, "bits array<tinyint>, label string, y double")


def _decode(blobs: DataFrame, blob: str, keep: list[str], layout: np.dtype, columns: str) -> DataFrame:
    split = blobs.select(*keep, F.posexplode(F.split(F.col(blob), r"\.")).alias("ram_id", "_b"))
    parts = split.withColumn("_b", F.unbase64("_b"))
    kept = parts.schema
    names = list(layout.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [np.frombuffer(b, layout) for b in pdf["_b"]]
            sizes = [len(d) for d in data]
            out = pdf.drop(columns="_b").loc[pdf.index.repeat(sizes)].reset_index(drop=True)
            entries = np.concatenate(data) if data else np.empty(0, layout)
            for n in names:
                values = entries[n]
                if n == "address":
                    values = values.astype("int64")
                out[n] = values
            yield out

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.fields if f.name != "_b"]
    return parts.mapInPandas(run, ", ".join([*fields, columns]))


def read_counts(blobs: DataFrame, blob: str = "blob", keep: list[str] | None = None) -> DataFrame:
    """Memory contents of classifiers: ``(keep..., ram_id, address, cnt)``, one blob per row."""
    return _decode(blobs, blob, keep or [], COUNT_ENTRY, "address bigint, cnt bigint")


def read_regression(blobs: DataFrame, blob: str = "blob", keep: list[str] | None = None) -> DataFrame:
    """Memory contents of regressors: ``(keep..., ram_id, address, cnt, sum_y, pending)``."""
    return _decode(
        blobs, blob, keep or [], REGRESSION_ENTRY, "address bigint, cnt double, sum_y double, pending double"
    )


def lookup(contents: DataFrame, ram_id: int, address: int | None = None) -> DataFrame:
    """The entries of one tuple, or the one at an address."""
    hits = contents.where(F.col("ram_id") == ram_id)
    return hits if address is None else hits.where(F.col("address") == address)
