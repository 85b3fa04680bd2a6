"""Suffix-array dedup: passages of ``LENGTH`` or more words that occur again, in any document.

Sparse suffix arrays: of all suffixes only those at minimiser positions are kept. A position is one
if, in some stretch of ``WINDOW`` positions that begins a passage of ``LENGTH`` words, its run of
``GRAM`` words has the least hash; equal passages keep the same positions, and a passage keeps one
that ``DEPTH`` words of it follow. The kept suffixes are sorted by the hash of their first ``DEPTH``
words (Spark's shuffle); neighbours that agree are candidates. A candidate is extended to the left
and right over the alignments of a passage of ``LENGTH`` words that contain it; passages that occur
twice are matches, and overlapping or adjacent ones merge into maximal spans. So every repeated
passage of ``LENGTH`` words is found, and nothing else.

Scale: the text is read twice and never shuffled. One key in about twelve words is shuffled first,
combined before; the alignments of candidates follow. Exact copies are known by a digest and do not
make candidates of each other, so groups of copies cost one row each. A passage in a third of all
texts combines before the shuffle; its way back is a plain inner join, whose hot side Spark splits.
Positions are gathered per document only. A fixed-size bit map of the candidates' hashes is
broadcast; it is sized by their count and at most 128 MB, and exact joins follow it.

Defined cases: null or empty texts and texts of fewer than ``LENGTH`` words have no spans; repeated
rows with one id are one document; a null id is an id (rows without one and of equal text are one
document); of equal passages the first in order of id, then place, is not ``later``. An empty table
gives an empty table. Only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.llm.common import let, stored
from ethospark.llm.jaccard_join import _bit_map
from ethospark.llm.text import U64, Words, _power, as_long, mix, pieces

LENGTH, GRAM, WINDOW = 50, 8, 24
DEPTH = LENGTH - WINDOW + 1


class Runs:
    """Hashes of runs of words of a slice, of any length."""

    def __init__(self, words: Words):
        self.words, n = words, len(words.hash)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(words.hash * _power("up", n), out=self.sums[1:])

    def of(self, begin: np.ndarray, length) -> np.ndarray:
        value = (self.sums[begin + length] - self.sums[begin]) * _power("down", len(self.sums))[begin]
        return mix(value + np.asarray(length, np.uint64))

    def digests(self) -> np.ndarray:
        """Of every row's whole sequence of words."""
        bounds = self.words.bounds
        return self.of(bounds[:-1], np.diff(bounds))

    def anchors(self) -> np.ndarray:
        """The minimiser positions, ascending."""
        doc = self.words.doc
        n = len(doc) - LENGTH + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        inside = doc[:n] == doc[LENGTH - 1 :]  # a passage begins here
        gram = self.of(np.arange(n + WINDOW - 1), GRAM)
        least = np.where(inside, _slide(np.minimum, gram, n), U64(0))
        # the greatest least hash of the stretches that hold a position
        padded = np.concatenate([np.zeros(WINDOW - 1, U64), least, np.zeros(WINDOW - 1, U64)])
        return np.flatnonzero(_slide(np.maximum, padded, n + WINDOW - 1) == gram)


def _slide(least, values: np.ndarray, n: int) -> np.ndarray:
    """least (or greatest) of WINDOW values from each of the first n places."""
    width = 1
    while 2 * width <= WINDOW:
        values = least(values[: len(values) - width], values[width:])
        width *= 2
    rest = WINDOW - width
    return least(values[:n], values[rest : rest + n])


def _keys(docs: DataFrame) -> DataFrame:
    """(key, lo, hi): kept suffixes with the least and greatest occurrence in a task; an occurrence is
    known by the text's digest and, where a text has the suffix twice, differs from the other."""

    def task(batches):
        for piece in pieces(batches):
            runs = Runs(Words(piece.column("text")))
            at = runs.anchors()
            keys, digests = runs.of(at, DEPTH), runs.digests()[runs.words.doc[at]]
            order = np.lexsort((keys, digests))
            keys, digests = keys[order], digests[order]
            again = np.zeros(len(keys), bool)
            again[1:] = (keys[1:] == keys[:-1]) & (digests[1:] == digests[:-1])
            digests[again] ^= U64(1)
            yield pa.record_batch([as_long(keys), as_long(digests)], ["key", "d"])

    return docs.select("text").mapInArrow(task, "key long, d long").groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))


def _passages(docs: DataFrame, keys: DataFrame, id_kind: str) -> DataFrame:
    """(hash, same, id, digest, start) of the passages around candidates; ``same`` is equal for
    the same place of copies."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(keys, keys.count()))

    def task(batches):
        array = sent.value
        shift = U64(64 - (len(array).bit_length() + 5))
        for piece in pieces(batches):
            words = Words(piece.column("text"))
            runs = Runs(words)
            at = runs.anchors()
            cell = runs.of(at, DEPTH) >> shift
            at = at[((array[cell >> U64(6)] >> (cell & U64(63))) & U64(1)).astype(bool)]
            begin = np.unique((at[:, None] - np.arange(WINDOW)).ravel())
            begin = begin[(begin >= 0) & (begin + LENGTH <= len(words.doc))]
            begin = begin[words.doc[begin] == words.doc[begin + LENGTH - 1]]
            row = words.doc[begin]
            start, digest = begin - words.bounds[row], runs.digests()[row]
            yield pa.record_batch(
                [as_long(runs.of(begin, LENGTH)), as_long(mix(digest + start.astype(U64))), piece.column("id").take(pa.array(row)), as_long(digest), pa.array(start.astype(np.int32))],
                ["hash", "same", "id", "digest", "start"],
            )

    return docs.mapInArrow(task, f"hash long, same long, id {id_kind}, digest long, start int")


def _spans(starts: Column) -> Column:
    """Sorted starts of passages → merged [(start, end)]."""

    def merge(a: Column) -> Column:
        far = lambda x, y: F.coalesce(x - y > LENGTH, F.lit(True))
        begin = F.filter(a, lambda x, i: far(x, F.get(a, i - 1)))
        end = F.filter(a, lambda x, i: far(F.get(a, i + 1), x))
        return F.zip_with(begin, end, lambda b, e: F.struct(b.cast("long").alias("start"), (e + LENGTH).cast("long").alias("end")))

    return let(F.sort_array(starts), merge)


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, n_words, n_repeated (words in a repeated passage), ``spans`` [(start, end)] of
    words, and ``later``: the spans to remove so that the first occurrence of each passage stays."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_kind = docs.schema[id_column].dataType.simpleString()

    def summary(batches):
        for piece in pieces(batches):
            runs = Runs(Words(piece.column("text")))
            yield pa.record_batch([piece.column("id"), as_long(runs.digests()), pa.array(np.diff(runs.words.bounds))], ["id", "digest", "n_words"])

    summaries = stored(rows.mapInArrow(summary, f"id {id_kind}, digest long, n_words long"), "suffix-rows")
    copies = (
        summaries.filter(F.col("n_words") >= LENGTH).groupBy("digest", "n_words")
        .agg(F.min(F.struct("id")).alias("first"), F.max(F.struct("id")).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).select("digest", "n_words", F.col("first.id").alias("first_id"), F.lit(True).alias("copied"))
    )
    keys = stored(_keys(rows).filter("lo <> hi").select("key"), "suffix-keys")
    passages = stored(_passages(rows, keys, id_kind), "suffix-passages")
    place = F.struct("id", "start")
    again = (
        passages.groupBy("hash").agg(F.min("same").alias("lo"), F.max("same").alias("hi"), F.min(place).alias("first"))
        .filter("lo <> hi").select("hash", "first")
    )
    found = (
        passages.join(again, "hash")
        .groupBy("id", "digest")
        .agg(F.collect_set("start").alias("starts"), F.collect_set(F.when(~place.eqNullSafe(F.col("first")), F.col("start"))).alias("later"))
        .select(F.col("id").alias("fid"), F.col("digest").alias("fdigest"), _spans(F.col("starts")).alias("spans"), _spans(F.col("later")).alias("later"))
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    joined = summaries.join(copies, ["digest", "n_words"], "left").join(
        found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("digest") == F.col("fdigest")), "left"
    )
    spans = F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", empty))
    later = F.when(F.col("copied") & ~F.col("id").eqNullSafe(F.col("first_id")), whole).otherwise(F.coalesce("later", empty))
    return joined.select(F.col("id").alias(id_column), "n_words", spans.alias("spans"), later.alias("later")).select(
        id_column, "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start).alias("n_repeated"), "spans", "later",
    )
