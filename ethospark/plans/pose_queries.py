"""Pose queries: points, identities, tracks, hulls."""

from pyspark.sql import functions as F

from ethospark.functions.polygons import perimeter
from ethospark.operators import frames as FR
from ethospark.operators import pose as P
from ethospark.plans.registry import query, rounded

ANIMAL = P.ANIMAL
POINTS = P.POINTS


def _rounded_points(df):
    return df.select(
        *ANIMAL, "frame", *[rounded(f"{a}_{k}").alias(f"{a}_{k}") for a in "xy" for k in POINTS]
    )


_POINTS_SQL = ", ".join(f"round({a}_{k}, 6) AS {a}_{k}" for a in "xy" for k in range(12))


@query("pose_points", f"SELECT video, identity, frame, {_POINTS_SQL} FROM v_pose")
def pose_points(v):
    """Stored (y, x) points and confidences → masked wide points."""
    raw = v.raw_instance().select(
        "video", F.col("instance").alias("identity"), "frame",
        F.transform("keypoints", lambda p: F.array(p["y"], p["x"])).alias("points"),
        F.transform("keypoints", lambda p: p["conf"]).alias("confidence"),
    )
    flipped = raw.withColumn("keypoints", P.from_yx(F.col("points"), F.col("confidence")))
    return _rounded_points(P.widen(flipped.drop("points", "confidence")))


_RAW_SQL = ", ".join(f"round(r{a}_{k}, 6) AS {a}_{k}" for a in "xy" for k in range(12))
_OK_SQL = ", ".join(f"conf_{k} > 0.3 AS ok_{k}" for k in range(12))


@query(
    "pose_points_keep_unsure",
    f"SELECT video, instance AS identity, frame, {_RAW_SQL}, {_OK_SQL} FROM v_raw_instance",
)
def pose_points_keep_unsure(v):
    raw = v.raw_instance().select("video", F.col("instance").alias("identity"), "frame", "keypoints")
    wide = P.widen(raw, keep_unsure=True)
    return wide.select(
        *ANIMAL, "frame", *[rounded(f"{a}_{k}").alias(f"{a}_{k}") for a in "xy" for k in POINTS],
        *[f"ok_{k}" for k in POINTS],
    )


# instances 0 and 1 claim the same identity here, so the later instance has to win
@query(
    "pose_assign_identities",
    """SELECT video, greatest(embed_id - 1, 1) - 1 AS identity, frame,
              round(arg_max(rx_0, instance), 6) AS x_0, max(instance) AS instance
       FROM v_raw_instance WHERE id_mask = 0 GROUP BY ALL""",
)
def pose_assign_identities(v):
    raw = v.raw_instance().withColumn("embed_id", F.greatest(F.col("embed_id") - 1, F.lit(1)))
    raw = raw.withColumn("kept", F.col("instance"))
    return P.assign_identities(raw, ["keypoints", "kept"]).select(
        *ANIMAL, "frame", rounded(F.get("keypoints", F.lit(0))["x"]).alias("x_0"),
        F.col("kept").alias("instance"),
    )


@query(
    "pose_identity_counts",
    """SELECT video, max(embed_id) AS num_identities FROM v_raw_instance
       WHERE id_mask = 0 GROUP BY video""",
)
def pose_identity_counts(v):
    return P.identity_counts(v.raw_instance())


@query(
    "pose_presence",
    """SELECT video, identity, frame, p.frame IS NOT NULL AS present FROM v_pose
       LEFT JOIN (SELECT *, TRUE AS here FROM v_pose_present) p USING (video, identity, frame)"""
    .replace("p.frame IS NOT NULL", "coalesce(here, FALSE)"),
)
def pose_presence(v):
    return P.with_presence(v.pose()).select(*ANIMAL, "frame", "present")


@query(
    "pose_keypoint_availability",
    "SELECT video, "
    + ", ".join(f"bool_or(x_{k} IS NOT NULL) AS ok_{k}" for k in range(12))
    + ", CASE WHEN "
    + " OR ".join(f"bool_or(x_{k} IS NOT NULL)" for k in (3, 4, 5, 6, 7, 8, 10))
    + " THEN 12 ELSE 5 END::INT AS layout FROM v_pose GROUP BY video",
)
def pose_keypoint_availability(v):
    return P.keypoint_availability(v.pose())


_SCALE = """
    scales AS (SELECT DISTINCT 'v' || label AS video, 0.05 + label * 0.01 AS cm_per_pixel
               FROM embeddings WHERE label <> 3)"""


def scales(v):
    """Half of a centimetre scale per video; video v3 has none."""
    return (
        v.table("embeddings")
        .filter(F.col("label") != 3)
        .select(
            F.concat(F.lit("v"), F.col("label")).alias("video"),
            (F.lit(0.05) + F.col("label") * F.lit(0.01)).alias("cm_per_pixel"),
        )
        .distinct()
    )


@query(
    "pose_scaled",
    f"""WITH {_SCALE} SELECT video, identity, frame, """
    + ", ".join(
        f"round({a}_{k} * coalesce(cm_per_pixel, 1), 6) AS {a}_{k}" for a in "xy" for k in range(12)
    )
    + " FROM v_pose LEFT JOIN scales USING (video)",
)
def pose_scaled(v):
    return _rounded_points(P.to_cm(v.pose(), scales(v)))


@query(
    "pose_display_names",
    """WITH ids AS (SELECT DISTINCT video, identity FROM v_pose),
    names AS (SELECT video, identity, 'tag' || (identity + 100) AS external FROM ids WHERE identity < 2)
    SELECT video, identity, coalesce(external, identity::VARCHAR) AS display
    FROM ids LEFT JOIN names USING (video, identity)""",
)
def pose_display_names(v):
    ids = v.pose().select(*ANIMAL).distinct()
    mapping = ids.filter(F.col("identity") < 2).withColumn(
        "external", F.concat(F.lit("tag"), F.col("identity") + 100)
    )
    return P.display_names(ids, mapping)


_BOX = """(embedding[37]::DOUBLE + 1) * 400 AS x1, (embedding[38]::DOUBLE + 1) * 400 AS y1,
    (embedding[37]::DOUBLE + 1) * 400 + (abs(embedding[39]::DOUBLE) + 0.2) * 300 AS x2,
    (embedding[38]::DOUBLE + 1) * 400 + (abs(embedding[40]::DOUBLE) + 0.2) * 300 AS y2"""


@query(
    "pose_boxes_by_identity",
    f"""WITH boxes AS (SELECT video, instance, frame, {_BOX} FROM v_raw_instance
                       WHERE id_mask = 0 AND embed_id <= 2)
    SELECT video, instance AS identity, frame, round(x1, 6) AS x1, round(y1, 6) AS y1,
           round(x2, 6) AS x2, round(y2, 6) AS y2 FROM boxes""",
)
def pose_boxes_by_identity(v):
    """Videos are said to hold two identities, so boxes of the third are dropped."""
    src, _ = v.boxes()
    raw = v.raw_instance().select("video", "instance", "frame", "embed_id", "id_mask")
    boxes = src.withColumnRenamed("identity", "instance").join(raw, ["video", "instance", "frame"])
    counts = raw.select("video").distinct().withColumn("num_identities", F.lit(2))
    return P.boxes_by_identity(boxes, counts).select(
        *ANIMAL, "frame", *[rounded(c).alias(c) for c in ("x1", "y1", "x2", "y2")]
    )


_CONTOUR_POINTS = ", ".join(
    f"{{'x': floor((embedding[{45 + 2 * i}]::DOUBLE + 1) * 400), "
    f"'y': floor((embedding[{46 + 2 * i}]::DOUBLE + 1) * 400)}}"
    for i in range(8)
)
# external contour points (contour 0) and hole points (contour 1), in order around their mean
CONTOUR_SQL = f"""
    raw_points AS (
        SELECT video, instance AS identity, frame, unnest([{_CONTOUR_POINTS}]) AS p
        FROM v_raw_instance WHERE id_mask = 0),
    centred AS (
        SELECT video, identity, frame, p.x AS x, p.y AS y,
               avg(p.x) OVER w AS mx, avg(p.y) OVER w AS my
        FROM raw_points WINDOW w AS (PARTITION BY video, identity, frame)),
    contour_points AS (
        SELECT video, identity, frame, 0 AS contour, x, y, atan2(y - my, x - mx) AS a FROM centred
        UNION ALL
        SELECT video, identity, frame, 1, floor(mx + (x - mx) / 4), floor(my + (y - my) / 4),
               atan2(y - my, x - mx) FROM centred),
    contour_edges AS (
        SELECT video, identity, frame, contour, x AS x0, y AS y0,
               coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1,
               coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
        FROM contour_points
        WINDOW w AS (PARTITION BY video, identity, frame, contour ORDER BY a, x, y))"""


@query(
    "pose_segments_by_identity",
    f"""WITH {CONTOUR_SQL}
    SELECT video, identity, frame, contour, contour = 0 AS is_external, count(*)::INT AS points,
           round(sum(x), 6) AS sum_x, round(sum(y), 6) AS sum_y
    FROM contour_points GROUP BY ALL""",
)
def pose_segments_by_identity(v):
    trimmed = P.trim_contours(P.segments_by_identity(v.contour()))
    total = lambda a: F.aggregate("pts", F.lit(0.0), lambda s, p: s + p[a])
    return trimmed.select(
        *ANIMAL, "frame", "contour", "is_external", F.size("pts").alias("points"),
        rounded(total("x")).alias("sum_x"), rounded(total("y")).alias("sum_y"),
    )


@query(
    "pose_dynamic_objects",
    """SELECT video, identity, frame AS sample_frame, 1 AS n,
              round(CASE WHEN frame % 2 = 0 THEN value ELSE frame::DOUBLE END, 6) AS x,
              round(CASE WHEN frame % 2 = 0 THEN frame::DOUBLE ELSE value END, 6) AS y
       FROM v_sequence WHERE event_type = 'purchase'""",
)
def pose_dynamic_objects(v):
    """Odd samples are stored (y, x), even ones say they are (x, y)."""
    pair = F.array(F.col("x"), F.col("sample_frame").cast("double"))
    raw = v.dynamic_object().select(
        *ANIMAL, "sample_frame", "n", F.array(F.array(pair)).alias("points"),
        F.when(F.col("sample_frame") % 2 == 0, "xy").otherwise("yx").alias("axis_order"),
    )
    point = F.get(F.get("points", F.lit(0)), F.lit(0))
    return P.normalize_dynamic_objects(raw).select(
        *ANIMAL, "sample_frame", "n", rounded(point["x"]).alias("x"), rounded(point["y"]).alias("y")
    )


@query(
    "pose_bearing",
    """SELECT video, identity, frame, round(bearing, 6) AS bearing FROM v_pose
       LEFT JOIN v_bearing USING (video, identity, frame)""",
)
def pose_bearing(v):
    return P.with_bearing(P.with_presence(v.pose())).select(
        *ANIMAL, "frame", rounded("bearing").alias("bearing")
    )


@query(
    "pose_hull",
    """WITH edges AS (
        SELECT video, identity, frame, count(*) AS vertices,
               sum(sqrt((tx - ax) * (tx - ax) + (ty - ay) * (ty - ay))) AS outline
        FROM v_hull_edge GROUP BY ALL)
    SELECT video, identity, frame, e.vertices::INT AS vertices, round(outline, 6) AS outline,
           round(area, 6) AS area
    FROM v_pose LEFT JOIN edges e USING (video, identity, frame)
    LEFT JOIN v_centroid USING (video, identity, frame)""",
)
def pose_hull(v):
    points = "zip_with(hull.hx, hull.hy, (x, y) -> named_struct('x', x, 'y', y))"
    return P.with_hull(v.pose()).selectExpr(
        *ANIMAL, "frame", "IF(hull IS NULL, NULL, size(hull.hx)) AS vertices",
        f"IF(hull IS NULL, NULL, round({perimeter(points)}, 6)) AS outline", "round(hull.area, 6) AS area",
    )


@query(
    "pose_hull_centroid",
    """SELECT video, identity, frame, round(cx, 6) AS cx, round(cy, 6) AS cy
       FROM v_pose LEFT JOIN v_centroid USING (video, identity, frame)""",
)
def pose_hull_centroid(v):
    return P.with_centroid(v.pose()).select(
        *ANIMAL, "frame", rounded("cx").alias("cx"), rounded("cy").alias("cy")
    )


# --- tracks ---

_TRACKS = """
    track_rows AS (
        SELECT DISTINCT 'v' || (label % 5) AS video, (vec_id // 10)::INT AS frame,
               vec_id // 100 * 10 + label AS track_id FROM embeddings)"""


@query(
    "pose_track_table",
    f"""WITH {_TRACKS}
    SELECT video, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS length,
           max(frame) - min(frame) + 1 <> count(*) AS has_gap
    FROM track_rows GROUP BY ALL""",
)
def pose_track_table(v):
    return P.track_table(v.track()).drop("instance")


# the allocation as a walk over stretch ends and starts, with the free identities as a list
_ALLOCATED = f"""WITH RECURSIVE {_TRACKS},
    stretches AS (
        SELECT video, track_id, min(frame) AS began, max(frame) AS ended
        FROM (SELECT *, frame - row_number() OVER (PARTITION BY video, track_id ORDER BY frame) AS island
              FROM track_rows)
        GROUP BY video, track_id, island),
    happenings AS (
        SELECT video, track_id, began AS frame, 1 AS kind,
               began = min(began) OVER (PARTITION BY video, track_id) AS is_new FROM stretches
        UNION ALL SELECT video, track_id, ended + 1, 0, FALSE FROM stretches),
    walk AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame, kind, track_id) AS i FROM happenings),
    steps AS (
        SELECT DISTINCT video, 0::BIGINT AS i, range(100) AS free, CAST([] AS STRUCT(t BIGINT, id BIGINT)[]) AS owners
        FROM track_rows
        UNION ALL
        SELECT s.video, w.i,
               CASE WHEN w.kind = 0
                      THEN list_sort(list_append(s.free, list_filter(s.owners, lambda o: o.t = w.track_id)[1].id))
                    WHEN w.is_new THEN s.free[2:] ELSE s.free END,
               CASE WHEN w.is_new THEN list_append(s.owners, {{'t': w.track_id, 'id': s.free[1]}}) ELSE s.owners END
        FROM steps s JOIN walk w ON w.video = s.video AND w.i = s.i + 1),
    allocated AS (
        SELECT video, o.t AS track_id, o.id::INT AS identity
        FROM (SELECT video, unnest(owners) AS o FROM steps
              QUALIFY i = max(i) OVER (PARTITION BY video)))"""


@query("pose_allocate_identities", f"{_ALLOCATED} SELECT * FROM allocated")
def pose_allocate_identities(v):
    return P.allocate_identities(v.track())


@query("pose_allocate_in_pieces", f"{_ALLOCATED} SELECT * FROM allocated")
def pose_allocate_in_pieces(v):
    """The way of long videos: identities handed out token by token, over pieces of 16 frames."""
    return P.allocate_identities(v.track(), piece=16, at_once=1)


@query(
    "pose_identity_to_track",
    f"""{_ALLOCATED},
    sizes AS (SELECT video, max(frame) + 1 AS n FROM track_rows GROUP BY video),
    counts AS (SELECT video, max(identity) + 1 AS ids FROM allocated GROUP BY video),
    animals AS (SELECT video, n, unnest(range(ids))::INT AS identity FROM counts JOIN sizes USING (video)),
    dense AS (SELECT video, identity, unnest(range(n))::INT AS frame FROM animals)
    SELECT d.video, d.identity, d.frame, coalesce(o.track_id, -1) AS track_id
    FROM dense d LEFT JOIN (SELECT r.*, a.identity FROM track_rows r JOIN allocated a USING (video, track_id)) o
      ON o.video = d.video AND o.identity = d.identity AND o.frame = d.frame""",
)
def pose_identity_to_track(v):
    tracks = v.track()
    return P.identity_to_track(tracks, P.allocate_identities(tracks), P.video_lengths(tracks))


@query(
    "pose_frame_spine",
    """SELECT video, identity, unnest(range(num_frames))::INT AS frame FROM v_length""",
)
def pose_frame_spine(v):
    return FR.spine(v.lengths(), ["video", "identity"])
