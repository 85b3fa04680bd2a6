"""Pose sources: file choice, ear-tag tables, lixit summaries, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.functions.names import pose_stem, pose_version
from ethospark.operators.frames import lookup_join, seeded_draw, spine
from ethospark.skeleton import INDEX, NUM_KEYPOINTS, TRAINING_SEED

# Ear-tag keypoint number → keypoint.
EARTAG_KEYPOINTS = {1: "NOSE", 2: "LEFT_EAR", 3: "RIGHT_EAR", 4: "BASE_TAIL", 5: "TIP_TAIL"}
# Codes that stand for "no tag".
NO_TAG = ["", "00", "01"]


def pose_files(paths: DataFrame) -> DataFrame:
    """``path`` → video stem and version; only supported versions (2 to 8)."""
    path = F.col("path")
    return paths.select(
        "path", pose_stem(path).alias("video"), pose_version(path).alias("version")
    ).filter(F.col("version").between(2, 8))


def latest_pose_files(paths: DataFrame) -> DataFrame:
    """The highest-version pose file per video."""
    return pose_files(paths).groupBy("video").agg(
        F.max("version").alias("version"), F.max_by("path", "version").alias("path")
    )


def eartag_identities(rows: DataFrame) -> DataFrame:
    """(video, tag) → identity: tags in sorted order from 0."""
    tags = rows.select("video", F.trim(F.coalesce("eartag_code", F.lit(""))).alias("tag")).distinct()
    known = tags.filter(~F.col("tag").isin(*NO_TAG))
    order = Window.partitionBy("video").orderBy("tag")  # the tagged animals of one video
    return known.withColumn("identity", (F.row_number().over(order) - 1).cast("int"))


def eartag_poses(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ear-tag detections → dense poses with the 12 keypoint slots.

    ``rows``: (video, frame, eartag_code, kpt_1_x … kpt_5_y, bb_left, bb_top, bb_right, bb_bottom);
    ``lengths``: (video, num_frames). Coordinates lose their fraction; a point with both coordinates
    has confidence 1, every other slot is (0, 0) with confidence 0. Frames without a detection are
    masked; missing box sides are -1.
    """
    identities = eartag_identities(rows)
    points = [f"kpt_{k}_{a}" for k in EARTAG_KEYPOINTS for a in "xy"]
    tagged = rows.select(
        "video", "frame", F.trim(F.coalesce("eartag_code", F.lit(""))).alias("tag"), *points,
        "bb_left", "bb_top", "bb_right", "bb_bottom",
    )
    found = lookup_join(tagged, identities, ["video", "tag"], "inner").withColumn("_seen", F.lit(True))
    animals = identities.join(lengths, "video").select("video", "identity", "num_frames")
    dense = spine(animals, ["video", "identity"]).join(found, ["video", "identity", "frame"], "left")
    slots = {INDEX[name]: number for number, name in EARTAG_KEYPOINTS.items()}

    def slot(k: int) -> Column:
        if k not in slots:
            x = y = sure = F.lit(0.0)
        else:
            px, py = (F.nanvl(F.col(f"kpt_{slots[k]}_{a}").cast("double"), F.lit(None).cast("double")) for a in "xy")
            both = px.isNotNull() & py.isNotNull()
            whole = lambda v: F.when(both, v.cast("int").cast("double")).otherwise(0.0)
            x, y, sure = whole(px), whole(py), both.cast("double")
        return F.struct(x.alias("x"), y.alias("y"), sure.alias("conf"))

    side = lambda c: F.coalesce(F.nanvl(F.col(c).cast("float"), F.lit(None).cast("float")), F.lit(-1.0)).cast("double")
    seen = F.coalesce("_seen", F.lit(False))
    return dense.select(
        "video", "identity", "frame",
        F.array(*[slot(k) for k in range(NUM_KEYPOINTS)]).alias("keypoints"),
        (~seen).cast("int").alias("id_mask"),
        F.when(seen, F.col("identity") + 1).otherwise(0).alias("embed_id"),
        side("bb_left").alias("x1"), side("bb_top").alias("y1"),
        side("bb_right").alias("x2"), side("bb_bottom").alias("y2"),
    )


def lixit_objects(summary: DataFrame) -> DataFrame:
    """(video, keypoints = ARRAY<ARRAY<DOUBLE>>) → static-object rows, three points per lixit."""
    checked = F.when(F.size("keypoints") % 3 == 0, F.col("keypoints")).otherwise(
        F.raise_error(F.lit("lixit keypoints must come in threes: tip, left, right"))
        .cast("array<array<double>>")
    )
    points = summary.select("video", F.posexplode(checked).alias("pos", "p"))
    return points.select(
        "video", F.lit("lixit").alias("object"),
        F.floor(F.col("pos") / 3).cast("int").alias("instance"), (F.col("pos") % 3).alias("point"),
        F.get("p", F.lit(0)).cast("double").alias("x"), F.get("p", F.lit(1)).cast("double").alias("y"),
    )


# --- clips -----------------------------------------------------------------------------------


def clip_starts(
    lengths: DataFrame, count: int, start_frame: int | None = None, seed: int = TRAINING_SEED
) -> DataFrame:
    """(video, ``clip_start``) of the videos long enough for a clip of ``count`` frames.

    ``start_frame`` counts from 1; without it every video gets its own seeded random start.
    """
    room = F.col("num_frames") - count
    if start_frame is not None:
        start = F.lit(start_frame - 1)
    else:
        draw = F.conv(F.left(seeded_draw(seed, ["video"]), F.lit(15)), 16, 10).cast("bigint")
        start = draw % (F.greatest(room, F.lit(0)) + 1)
    starts = lengths.select("video", start.cast("int").alias("clip_start"), room.alias("_room"))
    fits = (F.col("_room") >= 0) & F.col("clip_start").between(0, F.col("_room"))
    return starts.filter(fits).select("video", "clip_start")


def clip_frames(rows: DataFrame, starts: DataFrame, count: int, frame: str = "frame") -> DataFrame:
    """Rows of the clip, with frames counted from its start."""
    inside = F.col(frame).between(F.col("clip_start"), F.col("clip_start") + count - 1)
    joined = lookup_join(rows, starts, ["video"], "inner").filter(inside)
    return joined.withColumn(frame, F.col(frame) - F.col("clip_start")).drop("clip_start")


def clip_samples(
    samples: DataFrame, starts: DataFrame, count: int, keys: list[str], frame: str = "sample_frame"
) -> DataFrame:
    """Sparse samples of the clip plus the last one before it, which moves to frame 0.

    ``keys`` identify one object's series (they start with ``video``).
    """
    values = [c for c in samples.columns if c not in (*keys, frame)]
    known = lookup_join(samples, starts, ["video"], "inner")
    shifted = known.withColumn("_at", F.col(frame) - F.col("clip_start"))
    within = shifted.filter(F.col("_at").between(0, count - 1))
    before = (
        shifted.filter(F.col("_at") < 0)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "_at").alias("_v"))
        .select(*keys, F.lit(0).alias(frame), "_v.*")
    )
    return before.unionByName(within.select(*keys, F.col("_at").alias(frame), *values))
