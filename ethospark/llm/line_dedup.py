"""Line dedup: remove later occurrences of three-line windows that repeat anywhere.

Lines are the ``\\n`` parts of a text that hold a word; other lines are kept and not counted. Every
run of three consecutive lines is a window, known by a 128-bit hash. The first occurrence of a
window (smallest id, then position) stays; the lines of all later ones go, overlapping windows
merged. Only DataFrame functions.

Scale: windows are narrow rows. Their first occurrences come from an aggregation that combines
before it shuffles, so a window in a third of all texts is a few rows per task; the join back is a
plain inner join, whose hot side Spark splits. Positions are gathered per document only.

Defined cases: null or empty text stays as it is; a text of fewer than three lines has no window;
rows that repeat (same id and text) are one document and keep one fate; texts that share an id are
ordered by their hash; a null id comes first. An empty table gives an empty table. Other columns
pass through; columns named ``__…`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import let

WIDTH = 3


def _no_ints() -> Column:
    return F.array().cast("array<int>")


def _lines(text: Column) -> Column:
    """[(at, line)] of the lines with a word; ``at`` counts all lines."""
    numbered = F.transform(F.split(text, "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    return F.filter(numbered, lambda x: x.line.rlike(r"[^\x20\x09-\x0D]"))


def _windows(text: Column, width: int) -> Column:
    def hashes(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(_no_ints())

        def window(i):
            parts = [F.get(lines, i + k).line for k in range(width)]
            return F.struct(i.alias("i"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))

        return F.transform(starts, window)

    return let(_lines(text), hashes)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the text cleaned, plus ``n_lines`` and ``n_removed`` (lines with a word)."""
    keys = [F.col(id_column).alias("__id"), F.xxhash64(text_column).alias("__hash")]
    windows = (
        docs.filter(F.col(text_column).isNotNull())
        .select(*keys, F.explode(_windows(F.col(text_column), width)).alias("w"))
        .select("__id", "__hash", F.col("w.i").alias("i"), F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2"))
    )
    place = F.struct("__id", "__hash", "i")
    first = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(F.col("first") != F.col("last"))
        .drop("last")
    )
    covered = (
        windows.join(first, ["h1", "h2"])
        .filter(place != F.col("first"))
        .groupBy("__id", "__hash")
        .agg(F.collect_set("i").alias("__starts"))
        .select(F.col("__id").alias("__cid"), F.col("__hash").alias("__chash"), "__starts")
    )
    own = docs.withColumn("__hash", F.xxhash64(text_column))
    match = own[id_column].eqNullSafe(covered["__cid"]) & (own["__hash"] == covered["__chash"])
    text, starts = F.col(text_column), F.coalesce("__starts", _no_ints())

    def cleaned(lines: Column) -> Column:
        # numbers among the counted lines → numbers among all lines
        gone = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + width - 1))))
        return F.transform(gone, lambda j: F.get(lines, j).at)

    def without(gone: Column) -> Column:
        def join(lines: Column) -> Column:
            stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.array_join(F.transform(stay, lambda j: F.get(lines, j)), "\n")

        return let(F.split(text, "\n"), join)

    # the array functions run for the texts that lose a line only
    hit = F.col("__starts").isNotNull()
    gone = F.when(hit, let(_lines(text), cleaned))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
    result = own.join(covered, match, "left").withColumn("__gone", gone)
    other = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    new_text = F.when(hit, without(F.col("__gone"))).otherwise(text)
    return result.select(
        *[new_text.alias(c) if c == text_column else F.col(c) for c in other],
        n_lines.alias("n_lines"),
        F.when(hit, F.size("__gone")).otherwise(0).cast("long").alias("n_removed"),
    )
