"""Moving labels and annotations from one pose version's identities to another's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.frames import exact_median, frames_of
from ethospark.operators.labels import TRACK

BOX = ["x1", "y1", "x2", "y2"]
BLOCK = [*TRACK, "start", "end", "present"]

# Tags and colours of the annotations that mark labels which could not be moved.
FAILED_TAG = {True: "behavior-remap-failed", False: "not-behavior-remap-failed"}
FAILED_COLOR = {True: "#FF8800", False: "#8888FF"}


def box_iou(a: str = "", b: str = "o_") -> Column:
    """Intersection over union of the boxes in columns ``<a>x1…`` and ``<b>x1…``; 0 if degenerate."""
    side = lambda p, lo, hi: F.col(p + hi) - F.col(p + lo)
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    area_a = side(a, "x1", "x2") * side(a, "y1", "y2")
    area_b = side(b, "x1", "x2") * side(b, "y1", "y2")
    inter = w * h
    ok = (w > 0) & (h > 0) & (area_a > 0) & (area_b > 0)
    return F.when(ok, inter / (area_a + area_b - inter)).otherwise(F.lit(0.0))


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with finite coordinates and positive width and height."""
    finite = F.lit(True)
    for c in BOX:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return boxes.filter(finite & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def interval_scores(intervals: DataFrame, source: DataFrame, destination: DataFrame) -> DataFrame:
    """Median IoU per interval and destination identity, over frames where both have a box.

    ``intervals``: (interval id ``iid``, video, identity, start, end). Pairs without a common
    usable frame score 0 and give no row.
    """
    frames = frames_of(intervals.select("iid", "video", "identity", "start", "end"))
    own = usable_boxes(source).select("video", "identity", "frame", *BOX)
    other = usable_boxes(destination).select(
        "video", "frame", F.col("identity").alias("dst_identity"), *[F.col(c).alias(f"o_{c}") for c in BOX]
    )
    paired = frames.join(own, ["video", "identity", "frame"]).join(other, ["video", "frame"])
    scored = paired.select("iid", "dst_identity", box_iou().alias("iou"))
    return exact_median(scored, ["iid", "dst_identity"], "iou").withColumnRenamed("median", "iou")


def best_identities(intervals: DataFrame, source: DataFrame, destination: DataFrame) -> DataFrame:
    """Interval → (``dst_identity``, ``iou``): highest score, lowest identity on ties.

    Without any overlap that is the video's lowest identity with score 0.
    """
    scores = interval_scores(intervals, source, destination).filter(F.col("iou") > 0)
    best = scores.groupBy("iid").agg(
        F.max(F.struct("iou", (-F.col("dst_identity")).alias("neg"))).alias("b")
    )
    lowest = destination.groupBy("video").agg(F.min("identity").alias("_lowest"))
    found = intervals.join(best, "iid", "left").join(lowest, "video", "left")
    return found.select(
        *intervals.columns,
        F.coalesce(-F.col("b.neg"), F.col("_lowest")).alias("dst_identity"),
        F.coalesce("b.iou", F.lit(0.0)).alias("iou"),
    )


def eligible_videos(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Videos whose both pose tables are version 8 with boxes and equally long.

    Inputs: (video, version, has_boxes, num_frames).
    """
    ready = (F.col("version") >= 8) & F.col("has_boxes")
    theirs = destination.filter(ready).select("video", F.col("num_frames").alias("_frames"))
    return source.filter(ready).join(theirs, "video").filter(F.col("num_frames") == F.col("_frames")).select("video")


def _numbered(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("iid", F.struct(*TRACK, "start", "end"))


def remap_blocks(
    blocks: DataFrame, source: DataFrame, destination: DataFrame, min_iou: float,
    source_counts: DataFrame | None = None,
) -> DataFrame:
    """Blocks with ``dst_identity``, ``iou`` and ``moved``.

    Blocks of identities the source pose does not have (``source_counts``: video,
    num_identities) are never moved; their ``orphan`` is true.
    """
    rows = blocks
    orphan = F.lit(False)
    if source_counts is not None:
        rows = blocks.join(source_counts.select("video", "num_identities"), "video", "left")
        orphan = F.coalesce(F.col("identity") >= F.col("num_identities"), F.lit(False))
    matched = best_identities(_numbered(rows.withColumn("orphan", orphan)), source, destination)
    moved = ~F.col("orphan") & F.col("dst_identity").isNotNull() & (F.col("iou") >= min_iou)
    return matched.withColumn("moved", moved).drop("iid", "num_identities")


def remapped_labels(remapped: DataFrame) -> DataFrame:
    """Label frames under the new identities; where blocks collide the later one counts.

    Blocks are written in order of source identity, then start.
    """
    painted = _painted(remapped)
    return painted.groupBy(*TRACK, "frame").agg(F.max_by("label", "seq").alias("label"))


def _painted(remapped: DataFrame) -> DataFrame:
    moved = remapped.filter("moved").select(
        "video", F.col("dst_identity").alias("identity"), "behavior", "start", "end",
        F.col("present").cast("int").alias("label"),
        F.struct("identity", F.col("start").alias("at")).alias("seq"),
    )
    return frames_of(moved)


def failure_annotations(remapped: DataFrame) -> DataFrame:
    """Video-level annotations that mark the blocks which found no match."""
    lost = remapped.filter(~F.col("moved") & ~F.col("orphan"))
    pick = lambda values: F.when(F.col("present"), values[True]).otherwise(values[False])
    return lost.select(
        "video", "start", "end", pick(FAILED_TAG).alias("tag"), pick(FAILED_COLOR).alias("color")
    ).distinct()


def remap_counts(remapped: DataFrame) -> DataFrame:
    """Moved and skipped blocks per video."""
    return remapped.groupBy("video").agg(
        F.count_if("moved").alias("moved"), F.count_if(~F.col("moved")).alias("skipped")
    )


def overlap_report(remapped: DataFrame) -> DataFrame:
    """Per moved block: frames that already carried the same or the other label when written."""
    order = Window.partitionBy(*TRACK, "frame").orderBy("seq")
    earlier = _painted(remapped).withColumn("_before", F.lag("label").over(order))
    return (
        earlier.filter(F.col("_before").isNotNull())
        .groupBy("video", "behavior", F.col("seq.identity").alias("src_identity"),
                 F.col("identity").alias("dst_identity"), F.col("seq.at").alias("start"))
        .agg(
            F.count_if(F.col("_before") == F.col("label")).alias("identical"),
            F.count_if(F.col("_before") != F.col("label")).alias("conflicting"),
        )
    )


def remap_annotations(
    annotations: DataFrame, source: DataFrame, destination: DataFrame, min_iou: float
) -> DataFrame:
    """Identity annotations under the new identity, video-level ones as they are; no duplicates.

    Annotations whose identity finds no match are dropped. Of two that become the same (same
    frames, tag without case, identity) the one of the lowest source identity stays.
    """
    keyed = annotations.withColumn("iid", F.struct("video", "identity", "start", "end", "tag"))
    personal = keyed.filter(F.col("identity").isNotNull())
    matched = best_identities(personal, source, destination).filter(
        F.col("dst_identity").isNotNull() & (F.col("iou") >= min_iou)
    )
    shared = keyed.filter(F.col("identity").isNull()).withColumn("dst_identity", F.lit(None).cast("int"))
    rows = matched.select(*shared.columns).unionByName(shared)
    first = F.min(F.struct("identity", "tag", "color", "description")).alias("a")
    return rows.groupBy("video", "start", "end", F.lower("tag").alias("_tag"), "dst_identity").agg(first).select(
        "video", "start", "end", F.col("dst_identity").alias("identity"), "a.tag", "a.color", "a.description"
    )


def orphan_identities(
    blocks: DataFrame, annotations: DataFrame, counts: DataFrame
) -> DataFrame:
    """(video, identity) in labels or annotations that the pose (video, num_identities) lacks."""
    used = blocks.select("video", F.col("identity").cast("bigint").alias("identity")).unionByName(
        annotations.filter(F.col("identity").isNotNull()).select(
            "video", F.col("identity").cast("bigint").alias("identity")
        )
    )
    return (
        used.distinct().join(counts, "video").filter(F.col("identity") >= F.col("num_identities"))
        .select("video", "identity")
    )


def import_behaviors(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target settings plus those of behaviours only the source has."""
    new = source.join(target.select("behavior"), "behavior", "left_anti")
    return target.unionByName(new)


# Metadata keys that have to agree between videos.
MODEL_KEYS = ["pose_model_name", "pose_model_version", "detection_model_name", "detection_model_version"]


def model_metadata_problems(metadata: DataFrame) -> DataFrame:
    """What keeps the videos' model metadata from being one project-wide record.

    ``metadata``: (video, the four keys, ``has_metadata``). No rows: all present and equal, or none
    present.
    """
    none = F.lit("<none>")
    stats = metadata.agg(
        F.count(F.lit(1)).alias("videos"),
        F.count_if("has_metadata").alias("present"),
        *[
            F.count_distinct(F.when(F.col("has_metadata"), F.coalesce(F.col(k), none))).alias(k)
            for k in MODEL_KEYS
        ],
    )
    partly = (F.col("present") > 0) & (F.col("present") < F.col("videos"))
    problems = F.array(
        F.struct(F.lit("presence").alias("key"), partly.alias("bad")),
        *[F.struct(F.lit(k).alias("key"), (F.col(k) > 1).alias("bad")) for k in MODEL_KEYS],
    )
    return stats.select(F.explode(problems).alias("p")).filter("p.bad").select("p.key")
