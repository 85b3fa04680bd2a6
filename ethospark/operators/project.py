"""Project-level reports: video scan, capability, frame-count check, feature coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_VERSION = 17  # fixed value: version of the feature definitions


def scan(pose: DataFrame, objects: DataFrame, scales: DataFrame) -> DataFrame:
    """Per video: frames, identities, static objects, points per lixit, whether it has a scale."""
    sizes = pose.groupBy("video").agg(
        (F.max("frame") + 1).cast("int").alias("num_frames"),
        (F.max("identity") + 1).cast("int").alias("num_identities"),
    )
    arena = objects.groupBy("video").agg(
        F.array_sort(F.collect_set("object")).alias("objects"),
        F.max(F.when(F.col("object") == "lixit", F.col("point"))).alias("_last"),
    )
    scaled = scales.filter(F.col("cm_per_pixel").isNotNull()).select("video", F.lit(True).alias("_cm"))
    points = F.when(F.col("_last").isNull(), 0).when(F.col("_last") == 0, 1).otherwise(3)
    return (
        sizes.join(arena, "video", "left").join(scaled.distinct(), "video", "left")
        .select(
            "video", "num_frames", "num_identities",
            F.coalesce("objects", F.array().cast("array<string>")).alias("objects"),
            points.cast("int").alias("lixit_points"), F.coalesce("_cm", F.lit(False)).alias("has_scale"),
        )
    )


def capability(scanned: DataFrame, versions: DataFrame) -> DataFrame:
    """What all videos share: lowest pose version, common objects, lixit points, unit."""
    rows = scanned.join(versions, "video")
    total = rows.agg(
        F.min("version").alias("version"),
        F.count(F.lit(1)).alias("videos"),
        F.bool_and("has_scale").alias("_cm"),
        F.min(F.when(F.array_contains("objects", "lixit"), F.col("lixit_points"))).alias("_lixit"),
    )
    # the kinds of objects are a fixed handful, so this list is one short row
    kinds = rows.select(F.explode("objects").alias("object")).groupBy("object").agg(
        F.count(F.lit(1)).alias("n")
    )
    listed = kinds.agg(F.collect_list(F.struct("object", "n")).alias("kinds"))
    both = total.withColumn("_one", F.lit(1)).join(listed.withColumn("_one", F.lit(1)), "_one")
    common = F.array_sort(F.transform(
        F.filter("kinds", lambda s: s["n"] == F.col("videos")), lambda s: s["object"]
    ))
    return both.withColumn("objects", common).select(
        "version", "objects",
        F.when(F.array_contains("objects", "lixit"), F.col("_lixit")).otherwise(0).alias("lixit_points"),
        F.when(F.col("_cm"), "cm").otherwise("pixel").alias("unit"),
    )


def frame_count_mismatches(scanned: DataFrame, videos: DataFrame) -> DataFrame:
    """Videos whose own frame count differs from their pose table's."""
    counted = videos.select("video", F.col("num_frames").alias("video_frames"))
    return (
        scanned.select("video", F.col("num_frames").alias("pose_frames"))
        .join(counted, "video")
        .filter(F.col("pose_frames") != F.col("video_frames"))
    )


def _loadable(expects_cm: Column | None) -> Column:
    ok = F.col("per_frame_present") & (F.col("feature_version") == FEATURE_VERSION)
    if expects_cm is None:
        return ok
    return ok & (expects_cm.isNull() | (F.col("scale").isNotNull() == expects_cm))


def feature_coverage(meta: DataFrame, expected: DataFrame) -> DataFrame:
    """Per video: which cached features there are.

    ``meta`` has one row per cache (video, identity, feature_version, per_frame_present, scale,
    window_sizes); ``expected`` has (video, num_identities). A window size counts as full when every
    cached identity has it, else as partial.
    """
    animals = meta.groupBy("video", "identity").agg(F.bool_or("per_frame_present").alias("_ok"))
    per_video = animals.groupBy("video").agg(
        F.count(F.lit(1)).alias("cached_identities"),
        F.count_if(~F.col("_ok")).alias("missing_per_frame"),
    )
    caches = meta.groupBy("video").agg(
        F.array_sort(F.collect_set("feature_version")).alias("feature_versions"),
        F.max(F.col("feature_version") != FEATURE_VERSION).alias("is_stale"),
        F.min(F.col("scale").isNotNull()).alias("_cm_all"),
        F.max(F.col("scale").isNotNull()).alias("_cm_any"),
    )
    sizes = (
        meta.select("video", "identity", F.explode("window_sizes").alias("size")).distinct()
        .groupBy("video", "size").agg(F.count(F.lit(1)).alias("_n"))
        .join(per_video.select("video", "cached_identities"), "video")
        .groupBy("video")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_n") == F.col("cached_identities"), F.col("size")))).alias("window_sizes"),
            F.array_sort(F.collect_list(F.when(F.col("_n") < F.col("cached_identities"), F.col("size")))).alias("partial_window_sizes"),
        )
    )
    none = F.array().cast("array<int>")
    cached = F.coalesce("cached_identities", F.lit(0))
    complete = (cached > 0) & (cached >= F.col("num_identities")) & (F.col("missing_per_frame") == 0)
    return (
        expected.join(per_video, "video", "left").join(caches, "video", "left").join(sizes, "video", "left")
        .select(
            "video", cached.alias("cached_identities"),
            F.coalesce("missing_per_frame", F.lit(0)).alias("missing_per_frame"),
            F.coalesce(complete, F.lit(False)).alias("is_complete"),
            F.coalesce("window_sizes", none).alias("window_sizes"),
            F.coalesce("partial_window_sizes", none).alias("partial_window_sizes"),
            F.coalesce("feature_versions", none).alias("feature_versions"),
            F.coalesce("is_stale", F.lit(False)).alias("is_stale"),
            F.when(F.col("_cm_all") == F.col("_cm_any"), F.col("_cm_any")).alias("cm_units"),
        )
    )


def videos_missing_window(
    meta: DataFrame, required: DataFrame, size: int, cm_videos: DataFrame | None = None
) -> DataFrame:
    """Videos with a required (video, identity) that has no loadable features of a window size.

    A cache is loadable when it has the current version, per-frame features and, with
    ``cm_videos`` (video, ``expects_cm``), the wanted unit.
    """
    rows = meta
    unit = None
    if cm_videos is not None:
        rows = meta.join(cm_videos.select("video", "expects_cm"), "video", "left")
        unit = F.col("expects_cm")
    usable = rows.filter(_loadable(unit) & F.array_contains("window_sizes", size))
    covered = usable.select("video", "identity").distinct()
    return required.join(covered, ["video", "identity"], "left_anti").select("video").distinct()
