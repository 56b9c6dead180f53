"""Line deduplication by winnowing over line hashes.

Native.  A document is the sequence of its lines that hold words.  A repeated run is a sequence
of lines with at least ``words`` words that stands in the same order at an earlier place of the
corpus.  From each line the shortest window of lines with that many words is looked at, forwards
and backwards; every run contains at least one whole window of either kind.

1. Winnowing: the line with the smallest hash of a window is its fingerprint.  Fingerprints
   that one place of the corpus alone has selected cannot belong to a repeated run, and their
   windows end here.
2. Positions: the windows left are joined with the first place that holds the same window.
3. Runs: forward windows reach from the first line of a run as far as whole windows go, backward
   windows extend it to its last line.  Overlapping windows merge into one run.
4. The lines of later runs go; the first place keeps its lines.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Words of a repeated run, at least.
RUN_WORDS = 50
BLANK = " \t\x0b\f\r"


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_row``: which row of which file it is; rows that are not in files are written first."""
    try:
        return df.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return stored(df.withColumns({"_file": F.lit(0).cast("long"), "_row": F.monotonically_increasing_id()}))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id``, ``_file``, ``_row``, ``pos``, ``h``, ``before`` and ``upto`` (words) for each line with words."""
    split = docs.select(
        F.col(doc_id).alias("_id"), "_file", "_row", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")
    )
    counted = split.select(
        "_id", "_file", "_row", "pos",
        F.xxhash64(F.trim("line", F.lit(BLANK))).alias("h"),
        F.regexp_count("line", F.lit(WORD)).alias("n"),
    ).where("n > 0")
    above = Window.partitionBy("_file", "_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("n").over(above)).withColumn("before", F.col("upto") - F.col("n")).drop("n")


def windows_of(lines: DataFrame, words: int) -> DataFrame:
    """The shortest windows with ``words`` words from each line on, and up to each line.

    ``fp`` is the smallest hash of the window and ``fp_pos`` its line; ``key`` stands for the lines in order.
    """
    doc = Window.partitionBy("_file", "_row")
    ahead = doc.orderBy("before").rangeBetween(0, words - 1)
    behind = doc.orderBy("upto").rangeBetween(-(words - 1), 0)
    both = lines.withColumns(
        {
            "a_end": F.max("pos").over(ahead),
            "a_words": F.max("upto").over(ahead) - F.col("before"),
            "a_fp": F.min(F.struct("h", "pos")).over(ahead),
            "a_hashes": F.collect_list("h").over(ahead),
            "b_start": F.min("pos").over(behind),
            "b_words": F.col("upto") - F.min("before").over(behind),
            "b_fp": F.min(F.struct("h", "pos")).over(behind),
            "b_hashes": F.collect_list("h").over(behind),
        }
    )
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("pos").alias("start"), F.col("a_end").alias("end"), F.col("a_words").alias("size"),
                 F.col("a_fp").alias("fp"), F.xxhash64("a_hashes").alias("key"), F.hash("a_hashes").alias("key2")),
        F.struct(F.lit(1).alias("kind"), F.col("b_start").alias("start"), F.col("pos").alias("end"), F.col("b_words").alias("size"),
                 F.col("b_fp").alias("fp"), F.xxhash64("b_hashes").alias("key"), F.hash("b_hashes").alias("key2")),
    )
    return (
        both.select("_id", "_file", "_row", F.inline(kinds))
        .where(F.col("size") >= words)
        .select("_id", "_file", "_row", "kind", "start", "end", F.col("fp.h").alias("fp"), F.col("fp.pos").alias("fp_pos"), "key", "key2")
    )


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = RUN_WORDS) -> DataFrame:
    """The later repeated runs of documents that have ``_file`` and ``_row``.

    ``_file``, ``_row``, ``start`` and ``end`` (numbers of the first and the last line, from 0).
    Places are ordered by ``doc_id`` (null first), file, row and line.  Within one document, a
    window that overlaps the first place of its lines is no repetition.
    """
    windows = stored(windows_of(lines_of(docs, doc_id, text), words))
    # A place counts once for a fingerprint however many windows select it.
    places = windows.select("_file", "_row", "fp", "fp_pos").distinct()
    repeated = places.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    candidates = windows.join(repeated, "fp", "left_semi")
    place = F.struct("_id", "_file", "_row", "start", "end")
    first = candidates.groupBy("kind", "key", "key2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same_doc = (F.col("_file") == F.col("first._file")) & (F.col("_row") == F.col("first._row"))
    later = candidates.join(first.drop("n"), ["kind", "key", "key2"]).where(~same_doc | (F.col("start") > F.col("first.end")))
    # Windows that overlap or touch make one run.
    doc = Window.partitionBy("_file", "_row").orderBy("start", "end")
    reached = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("start") > reached + 1), 1).otherwise(0)
    numbered = later.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(doc))
    return numbered.groupBy("_file", "_row", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = RUN_WORDS) -> DataFrame:
    """Delete the lines of later repeated runs; adds ``n_lines``, ``deleted_lines`` and ``runs``.

    ``runs`` lists ``start``, ``end`` of what went, in line numbers of the text before.  Lines are
    compared without the white space around them; blank lines count for nothing, and go if they
    stand inside a run.  A null text stays null with 0 lines.  Rows that repeat are documents of
    their own, of which the first keeps its lines.  All columns stay; a column with the name of an
    added one is replaced.  No rows give no rows.
    """
    rows = with_row_id(docs)
    runs = repeated_runs(rows.select(doc_id, text, "_file", "_row"), doc_id=doc_id, text=text, words=words)
    listed = runs.groupBy("_file", "_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    lines = F.split(F.col(text), "\n")
    # What stays lies before, between and behind the runs.
    starts = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["end"] + 1))
    ends = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, F.greatest(b - a, F.lit(0)))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"] + 1)
    return (
        rows.join(listed, ["_file", "_row"], "left")
        .withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>")))
        .withColumn(text, F.when(F.col("_runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .withColumns({"n_lines": F.size("_lines"), "runs": F.coalesce("_runs", none)})
        .withColumn("deleted_lines", gone)
        .drop("_file", "_row", "_lines", "_runs")
        .select(*[c for c in docs.columns if c not in ("n_lines", "deleted_lines", "runs")], "n_lines", "deleted_lines", "runs")
    )
