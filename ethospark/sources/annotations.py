"""Annotation documents: labels and timeline annotations as JSON, one document per video or in bounded parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.functions.names import valid_tag
from ethospark.operators.frames import number_frames, piece_sql
from ethospark.schemas import ANNOTATIONS_JSON, DOCUMENT_JSON

PART = 4096  # blocks of a view, and annotations, that a part of a document holds


def parse_documents(texts: DataFrame, column: str = "json") -> DataFrame:
    """(video, json) → (video, doc) with the typed document; the column ``part`` stays."""
    return texts.select("video", *_part(texts), F.from_json(F.col(column), DOCUMENT_JSON).alias("doc"))


def load_blocks(documents: DataFrame, prefer_unfragmented: bool = True) -> DataFrame:
    """Label blocks of the documents: as drawn where stored, else the fragmented view.

    The parts of a document give the blocks of the whole one; their positions ascend from part to part.
    """
    part = _part(documents)
    tracks = F.col("doc.labels")
    if prefer_unfragmented:
        tracks = F.coalesce("doc.unfragmented_labels", "doc.labels")
    return (
        documents.select("video", *part, F.explode(tracks).alias("identity", "behaviors"))
        .select("video", *part, "identity", F.explode("behaviors").alias("behavior", "blocks"))
        .select("video", *part, F.col("identity").cast("bigint").alias("identity"), "behavior",
                F.posexplode("blocks").alias("position", "block"))
        .withColumn("position", F.expr("part * 2147483648L + position" if part else "position"))
        .select("video", "identity", "behavior", "position", "block.*")
    )


def _part(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "part"]


def _as_map(blocks: DataFrame, name: str, keys: Sequence[str] = ("video",)) -> DataFrame:
    """Blocks → one map identity → behavior → list per document."""
    block = F.struct("start", "end", "present")
    lists = blocks.groupBy(*keys, "identity", "behavior").agg(F.array_sort(F.collect_list(block)).alias("b"))
    tracks = lists.groupBy(*keys, "identity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("behavior", "b")))).alias("m")
    )
    entry = F.struct(F.col("identity").cast("string").alias("identity"), "m")
    return tracks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias(name))


def write_documents(
    blocks: DataFrame, fragmented: DataFrame, lengths: DataFrame, annotations: DataFrame | None = None
) -> DataFrame:
    """(video, json): one document per video with both label views.

    A document is one value by definition of the format; it holds the hand-drawn blocks of one
    video, not its frames. ``write_document_parts`` is for videos with more blocks than a row should hold.
    """
    docs = (
        lengths.select("video", "num_frames")
        .join(_as_map(fragmented, "labels"), "video", "left")
        .join(_as_map(blocks, "unfragmented_labels"), "video", "left")
    )
    fields: list[Column] = [
        F.lit(1).alias("version"), F.col("video").alias("file"), "num_frames", "labels", "unfragmented_labels",
    ]
    if annotations is not None:
        one = F.struct("start", "end", "tag", "color", "description", "identity")
        docs = docs.join(
            annotations.groupBy("video").agg(F.collect_list(one).alias("annotations")), "video", "left"
        )
        fields.append("annotations")
    return docs.select("video", F.to_json(F.struct(*fields)).alias("json"))


def write_document_parts(
    blocks: DataFrame, fragmented: DataFrame, lengths: DataFrame, annotations: DataFrame | None = None, size: int = PART
) -> DataFrame:
    """(video, part, json): documents that together hold what ``write_documents`` puts into one.

    The rows of each view are numbered by start in pieces of the video; every ``size`` of them are a part, so
    no row and no group grows with a video. Every part is a document of the format, part 0 of every
    video exists, and the readers above take parts as they take documents.
    """
    keys = ["video", "part"]
    views = {
        "labels": _as_map(_in_parts(fragmented, ["identity", "behavior"], size), "labels", keys),
        "unfragmented_labels": _as_map(_in_parts(blocks, ["identity", "behavior"], size), "unfragmented_labels", keys),
    }
    if annotations is not None:
        one = F.struct("start", "end", "tag", "color", "description", "identity")
        listed = _in_parts(annotations, ["tag"], size).groupBy(*keys)
        views["annotations"] = listed.agg(F.array_sort(F.collect_list(one)).alias("annotations"))
    # a row for each view of a part, put together by one grouping, so that every view is computed once
    begun = lengths.select("video", F.lit(0).alias("part"))
    rows = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), [begun, *views.values()])
    docs = rows.groupBy(*keys).agg(*[F.first(name, ignorenulls=True).alias(name) for name in views])
    docs = docs.join(lengths.select("video", "num_frames"), "video")
    fields = [F.lit(1).alias("version"), F.col("video").alias("file"), "num_frames", *views]
    return docs.select(*keys, F.to_json(F.struct(*fields)).alias("json"))


def _in_parts(rows: DataFrame, ties: Sequence[str], size: int) -> DataFrame:
    """Add ``part``: ``size`` rows of a video in order of their start."""
    order = ["start", "end", *ties]
    numbered = number_frames(rows, ["video"], order, piece_sql("start"), "part")
    return numbered.withColumn("part", F.floor(F.col("part") / size).cast("int"))


def load_annotations(texts: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(video, json array) → (accepted, rejected with ``reason``).

    Start, end, tag and colour are required; a tag has 1 to 32 letters, digits, ``_`` or ``-``.
    """
    rows = texts.select(
        "video", F.explode(F.from_json(F.col(column), ANNOTATIONS_JSON)).alias("a")
    ).select("video", "a.*")
    missing = F.col("start").isNull() | F.col("end").isNull() | F.col("tag").isNull() | F.col("color").isNull()
    bad_length = ~F.length("tag").between(1, 32)
    reason = (
        F.when(missing, "missing field").when(bad_length, "tag length").when(~valid_tag(F.col("tag")), "tag characters")
    )
    judged = rows.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())
