"""Pose normalisation: instances and tracks → one wide row per (video, identity, frame).

The wide pose has ``x_0…x_11``, ``y_0…y_11`` (pixels, NULL when unknown) and ``ok_0…ok_11``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethospark.functions import polygons
from ethospark.functions.angles import direction
from ethospark.operators import identities
from ethospark.operators.frames import PIECE, lookup_join, piece_of, runs, spine
from ethospark.session import scratch_folder
from ethospark.skeleton import BODY, DEFAULT_FPS, INDEX, MIN_CONFIDENCE, NUM_KEYPOINTS

ANIMAL = ["video", "identity"]
POINTS = range(NUM_KEYPOINTS)
BODY_POINTS = range(len(BODY))


# --- points -------------------------------------------------------------------------------


def from_yx(points: Column, confidence: Column) -> Column:
    """Stored (y, x) pairs and confidences → array of (x, y, conf)."""
    return F.zip_with(
        points, confidence,
        lambda p, c: F.struct(
            F.get(p, F.lit(1)).cast("double").alias("x"), F.get(p, F.lit(0)).cast("double").alias("y"),
            c.cast("double").alias("conf"),
        ),
    )


def widen(poses: DataFrame, keep_unsure: bool = False) -> DataFrame:
    """Keypoint array → wide columns; a point counts when its confidence is above the limit.

    Points that do not count become NULL. ``keep_unsure`` (pose versions 2 and 3) keeps their
    coordinates and only clears ``ok``.
    """
    columns = []
    for k in POINTS:
        sure = f"coalesce(keypoints[{k}].conf > {MIN_CONFIDENCE}D, FALSE)"
        for axis in "xy":
            value = f"nanvl(keypoints[{k}].{axis}, CAST(NULL AS DOUBLE))"
            columns.append(f"{value if keep_unsure else f'IF({sure}, {value}, NULL)'} AS {axis}_{k}")
        columns.append(f"{sure} AS ok_{k}")
    return poses.selectExpr("*", *columns).drop("keypoints")


BODY_COUNT = " + ".join(f"int(ok_{k})" for k in BODY_POINTS)


def with_presence(pose: DataFrame, version: int = 4) -> DataFrame:
    """Add ``present``: three valid body points, or one for pose version 3."""
    return pose.selectExpr("*", f"{BODY_COUNT} >= {1 if version == 3 else 3} AS present")


def keypoint_availability(pose: DataFrame) -> DataFrame:
    """Per video: whether each keypoint is ever valid, and the skeleton layout (12 or 5)."""
    five = {"NOSE", "LEFT_EAR", "RIGHT_EAR", "BASE_TAIL", "TIP_TAIL"}  # the reduced skeleton
    extra = " OR ".join(f"ok_{k}" for name, k in INDEX.items() if name not in five)
    seen = pose.groupBy("video").agg(*[F.expr(f"bool_or(ok_{k}) AS ok_{k}") for k in POINTS])
    return seen.selectExpr("*", f"IF({extra}, 12, 5) AS layout")


def video_facts(pose: DataFrame) -> DataFrame:
    """What features need to know about a whole video: its length and whether the neck ever shows."""
    neck = INDEX["BASE_NECK"]
    return pose.groupBy("video").agg(
        F.expr("CAST(max(frame) + 1 AS INT) AS num_frames"), F.expr(f"bool_or(ok_{neck}) AS has_neck")
    )


def with_bearing(pose: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Add ``bearing``: direction from tail base to neck, or to the nose in videos without neck.

    Needs ``present``; NULL on frames without the animal. The video facts are joined along the way.
    """
    facts = video_facts(pose) if facts is None else facts
    neck, nose, tail = INDEX["BASE_NECK"], INDEX["NOSE"], INDEX["BASE_TAIL"]
    ahead = {a: f"(IF(has_neck, {a}_{neck}, {a}_{nose}) - {a}_{tail})" for a in "xy"}
    angle = direction(ahead["x"], ahead["y"])
    return lookup_join(pose, facts, ["video"]).selectExpr(
        "*", f"CASE WHEN present THEN {angle} END AS bearing"
    ).drop("has_neck")


def scaled(pose: DataFrame, scales: DataFrame | None) -> DataFrame:
    """Add ``scale``: cm per pixel of the video, 1.0 where unknown or for pixel units.

    If ``scales`` has ``fps``, the frame rate of the video comes along (the default one where unknown).
    """
    if scales is None:
        return pose.withColumn("scale", F.lit(1.0))
    facts = {"scale": F.col("cm_per_pixel").cast("double")}
    if "fps" in scales.columns:
        facts["fps"] = F.col("fps").cast("double")
    known = scales.select("video", *[c.alias(n) for n, c in facts.items()])
    usual = {"scale": 1.0, "fps": DEFAULT_FPS}
    return lookup_join(pose, known, ["video"]).withColumns({n: F.coalesce(n, F.lit(usual[n])) for n in facts})


def to_cm(pose: DataFrame, scales: DataFrame) -> DataFrame:
    """Coordinates in cm instead of pixels."""
    rows = scaled(pose, scales)
    return rows.withColumns(
        {f"{a}_{k}": F.expr(f"{a}_{k} * scale") for a in "xy" for k in POINTS}
    ).drop("scale")


def video_lengths(pose: DataFrame) -> DataFrame:
    return pose.groupBy("video").agg((F.max("frame") + 1).cast("int").alias("num_frames"))


# --- hull ----------------------------------------------------------------------------------

HULL_TYPE = T.StructType([
    T.StructField("hx", T.ArrayType(T.DoubleType())),
    T.StructField("hy", T.ArrayType(T.DoubleType())),
    T.StructField("area", T.DoubleType()),
    T.StructField("cx", T.DoubleType()),
    T.StructField("cy", T.DoubleType()),
])


def body_arrays(batch: Sequence[pd.Series]) -> tuple[np.ndarray, np.ndarray]:
    """Body point columns (all x, then all y) → two (n, 10) arrays, NaN when missing."""
    half = len(BODY)
    x = np.column_stack([s.to_numpy(dtype=float) for s in batch[:half]])
    y = np.column_stack([s.to_numpy(dtype=float) for s in batch[half : 2 * half]])
    return x, y


def body_columns() -> list[Column]:
    """Valid body points as UDF arguments (all x, then all y)."""
    return [F.expr(f"IF(ok_{k}, {a}_{k}, NULL)") for a in "xy" for k in BODY_POINTS]


def with_hull(pose: DataFrame) -> DataFrame:
    """Add ``hull`` (hx, hy vertex arrays, area, centroid); NULL below three valid body points."""

    @F.pandas_udf(HULL_TYPE)
    def hull(*batch: pd.Series) -> pd.DataFrame:
        x, y = body_arrays(batch)
        hx, hy, count = polygons.hulls(x, y)
        area, cx, cy = polygons.hull_area_centroid(hx, hy)
        return pd.DataFrame({
            "hx": [v[:c].tolist() for v, c in zip(hx, count)],
            "hy": [v[:c].tolist() for v, c in zip(hy, count)],
            "area": area, "cx": cx, "cy": cy,
        })

    return pose.withColumn("hull", F.when(F.expr(f"{BODY_COUNT} >= 3"), hull(*body_columns())))


def with_centroid(pose: DataFrame) -> DataFrame:
    """Add the hull centroid ``cx``, ``cy`` (pixels), NULL without a hull."""

    @F.pandas_udf("cx double, cy double")
    def centroid(*batch: pd.Series) -> pd.DataFrame:
        hx, hy, _ = polygons.hulls(*body_arrays(batch))
        _, cx, cy = polygons.hull_area_centroid(hx, hy)
        return pd.DataFrame({"cx": cx, "cy": cy})

    rows = pose.withColumn("_c", centroid(*body_columns()))
    return rows.selectExpr(
        "*", *[f"CASE WHEN {BODY_COUNT} >= 3 THEN _c.{c} END AS {c}" for c in ("cx", "cy")]
    ).drop("_c")


# --- identities ------------------------------------------------------------------------------


def identity_counts(raw: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """Identities per video: rows of the identity-centre table, else the largest valid id."""
    largest = raw.filter(F.col("id_mask") == 0).groupBy("video").agg(
        F.max("embed_id").cast("int").alias("_largest")
    )
    videos = raw.select("video").distinct().join(largest, "video", "left")
    if centers is None:
        return videos.select("video", F.coalesce("_largest", F.lit(0)).alias("num_identities"))
    counted = centers.groupBy("video").agg(F.count(F.lit(1)).cast("int").alias("_centers"))
    return videos.join(counted, "video", "left").select(
        "video", F.coalesce("_centers", "_largest", F.lit(0)).alias("num_identities")
    )


def assign_identities(
    raw: DataFrame, payload: Sequence[str] = ("keypoints",), centers: DataFrame | None = None
) -> DataFrame:
    """Instances → identities: valid instances get ``embed_id - 1``.

    When one frame has an identity twice, the last instance counts. An id above the video's
    identity count raises.
    """
    valid = raw.filter(F.col("id_mask") == 0)
    if centers is not None:
        valid = lookup_join(valid, identity_counts(raw, centers), ["video"])
        bad = F.raise_error(F.concat(F.lit("embed_id out of range in "), F.col("video"))).cast("int")
        identity = F.when(F.col("embed_id") > F.col("num_identities"), bad).otherwise(F.col("embed_id") - 1)
    else:
        identity = F.col("embed_id") - 1  # the count is the largest id itself
    packed = F.struct(*payload)
    return (
        valid.withColumn("identity", identity.cast("int"))
        .groupBy("video", "identity", "frame")
        .agg(F.max_by(packed, "instance").alias("_p"))
        .select(*ANIMAL, "frame", "_p.*")
    )


def boxes_by_identity(raw: DataFrame, counts: DataFrame) -> DataFrame:
    """Bounding boxes of valid instances with an id in 1..num_identities, by identity."""
    valid = raw.filter((F.col("id_mask") == 0) & (F.col("embed_id") > 0))
    known = lookup_join(valid, counts, ["video"], "inner").filter(
        F.col("embed_id") <= F.col("num_identities")
    )
    return assign_identities(known, ["x1", "y1", "x2", "y2"])


def segments_by_identity(contours: DataFrame) -> DataFrame:
    """Contours with a long-term id (1-based, 0 = none), by identity."""
    return (
        contours.filter(F.col("seg_id") > 0)
        .withColumn("identity", (F.col("seg_id") - 1).cast("int"))
        .drop("seg_id")
    )


def trim_contours(contours: DataFrame) -> DataFrame:
    """Remove padding points (a coordinate of -1) and contours without points."""
    kept = F.filter("pts", lambda p: (p["x"] != -1) & (p["y"] != -1))
    return contours.withColumn("pts", kept).filter(F.size("pts") > 0)


def display_names(identities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``display``: the external id as text, else the identity index."""
    names = mapping.select(*ANIMAL, F.col("external").cast("string").alias("_external"))
    return identities.join(names, ANIMAL, "left").withColumn(
        "display", F.coalesce("_external", F.col("identity").cast("string"))
    ).drop("_external")


def normalize_dynamic_objects(objects: DataFrame) -> DataFrame:
    """Sparse object samples with points as ``ARRAY<ARRAY<(x, y)>>`` (object, keypoint).

    Input ``points`` is ``ARRAY<ARRAY<ARRAY<DOUBLE>>>`` (object, keypoint, 2) with an
    ``axis_order``; anything but ``xy`` is stored (y, x). Samples without points, count or frame
    are dropped, as are points that are not pairs.
    """
    pairs = F.forall(F.flatten("points"), lambda p: F.size(p) == 2)
    complete = F.col("points").isNotNull() & F.col("n").isNotNull() & F.col("sample_frame").isNotNull()
    flip = ~F.coalesce(F.col("axis_order") == "xy", F.lit(False))
    def point(p: Column) -> Column:
        return F.struct(
            F.when(flip, F.get(p, F.lit(1))).otherwise(F.get(p, F.lit(0))).alias("x"),
            F.when(flip, F.get(p, F.lit(0))).otherwise(F.get(p, F.lit(1))).alias("y"),
        )

    return objects.filter(complete & pairs).withColumn(
        "points", F.transform("points", lambda o: F.transform(o, point))
    ).drop("axis_order")


# --- tracks (pose version 3) ------------------------------------------------------------------


def track_table(instances: DataFrame) -> DataFrame:
    """First frame, rows and gap flag per (video, track). Rows stay at their true frame."""
    table = instances.groupBy("video", "track_id").agg(
        F.min("frame").alias("first_frame"),
        F.max("frame").alias("last_frame"),
        F.count(F.lit(1)).alias("length"),
        F.min_by("instance", "frame").alias("instance"),
    )
    span = F.col("last_frame") - F.col("first_frame") + 1
    return table.withColumn("has_gap", span != F.col("length"))


def _busy_blocks(tracks: DataFrame) -> DataFrame:
    """Add ``block``: frame where the video's current stretch with live tracks began.

    Tracks of different blocks cannot compete for an identity, so a block, not a video, is the
    unit of the sequential scan. A video with interrupted tracks is one block.
    """
    tracks = tracks.withColumn("_piece", piece_of("first_frame"))
    pieces = tracks.groupBy("video", "_piece").agg(
        F.max("last_frame").alias("_reach"), F.max("has_gap").alias("_gap")
    )
    earlier = Window.partitionBy("video").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("video")
    pieces = pieces.select(
        "video", "_piece", F.max("_reach").over(earlier).alias("_reach"),
        F.max("_gap").over(whole).alias("_any_gap"),
    )
    order = ["first_frame", "last_frame", "track_id"]
    here = Window.partitionBy("video", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = tracks.join(pieces, ["video", "_piece"]).withColumn(
        "_reach", F.greatest("_reach", F.max("last_frame").over(here))
    )
    begins = F.when(F.col("_reach").isNull() | (F.col("first_frame") > F.col("_reach")), F.col("first_frame"))
    rows = rows.withColumn("_begins", begins)
    firsts = rows.groupBy("video", "_piece").agg(F.max("_begins").alias("_opened"))
    firsts = firsts.select("video", "_piece", F.max("_opened").over(earlier).alias("_opened"))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(firsts, ["video", "_piece"])
        .withColumn("block", F.greatest("_opened", F.max("_begins").over(upto)))
        .withColumn("block", F.when(F.col("_any_gap"), 0).otherwise(F.col("block")))
        .drop("_piece", "_reach", "_begins", "_opened", "_any_gap")
    )


# a stretch with live tracks that has more track stretches than this is handed out in pieces
ALLOCATED_AT_ONCE = 1 << 16


def allocate_identities(instances: DataFrame, piece: int = PIECE, at_once: int = ALLOCATED_AT_ONCE) -> DataFrame:
    """Track → identity: a new track takes the lowest free identity.

    An identity is free again in the first frame without its track; an interrupted track releases it each
    time. A block of up to ``at_once`` track stretches is one walk in a stream of Arrow batches,
    in memory bounded by the tracks alive; larger blocks go through ``identities.hand_out``, piece by piece.
    """
    tracks = _busy_blocks(track_table(instances))
    stretches = runs(
        instances.select("video", "frame", "track_id"), ["video", "track_id"], []
    ).select("video", "track_id", "start", "end")
    rows = _stored(stretches.join(tracks, ["video", "track_id"]).select(
        "video", "block", "track_id", "start", "end", "instance", "first_frame", "last_frame"
    ), "track-stretches")
    sizes = rows.groupBy("video", "block").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > at_once).select("video", "block")
    if large.isEmpty():
        return _walk_blocks(rows)
    large = F.broadcast(_stored(large, "large-blocks"))  # at most a row for each ``at_once`` stretches
    mine = rows.join(large, ["video", "block"]).withColumn("unit", F.concat_ws("/", F.col("block").cast("string"), "video"))
    first = F.col("start") == F.col("first_frame")
    handed = identities.hand_out(
        mine.filter(first).select("unit", "track_id", "start", "instance", "end"),
        mine.filter(~first).select("unit", "track_id", "end"), piece,
    )
    units = mine.select("unit", "video").distinct()
    handed = handed.join(F.broadcast(units), "unit").select("video", "track_id", F.col("identity").cast("int").alias("identity"))
    return _walk_blocks(rows.join(large, ["video", "block"], "left_anti")).unionByName(handed)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _walk_blocks(rows: DataFrame) -> DataFrame:
    """Allocation by one walk per block, rows of ``allocate_identities``."""
    fields = [rows.schema["video"], rows.schema["track_id"], T.StructField("identity", T.IntegerType())]
    names = ["video", "block", "track_id", "start", "end", "first_frame", "last_frame"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, returning, live, free, fresh = None, {}, [], [], 0
        for batch in batches:
            out = []
            for video, block, track, start, end, first, last in zip(*(batch[n] for n in names)):
                if (video, block) != unit:
                    unit, returning, live, free, fresh = (video, block), {}, [], [], 0
                while live and live[0][0] < start:
                    heapq.heappush(free, heapq.heappop(live)[1])
                if start != first:
                    identity = returning[track]
                elif free:
                    identity = heapq.heappop(free)
                else:
                    identity, fresh = fresh, fresh + 1
                if start == first:
                    out.append((video, track, identity))
                if end < last:
                    returning[track] = identity
                heapq.heappush(live, (end, identity))
            yield pd.DataFrame(out, columns=["video", "track_id", "identity"])

    ordered = rows.repartition("video", "block").sortWithinPartitions(
        "video", "block", "start", "instance"
    )
    return ordered.mapInPandas(scan, T.StructType(fields))


def identity_to_track(instances: DataFrame, identities: DataFrame, lengths: DataFrame) -> DataFrame:
    """Track shown by each identity on each frame, -1 for none."""
    counts = identities.groupBy("video").agg(F.max("identity").alias("_last"))
    animals = lengths.join(counts, "video").withColumn(
        "identity", F.explode(F.sequence(F.lit(0), F.col("_last")))
    )
    shown = instances.select("video", "frame", "track_id")
    owned = lookup_join(shown, identities, ["video", "track_id"], "inner")
    return (
        spine(animals.select(*ANIMAL, "num_frames"), ANIMAL)
        .join(owned, [*ANIMAL, "frame"], "left")
        .select(*ANIMAL, "frame", F.coalesce("track_id", F.lit(-1)).alias("track_id"))
    )
