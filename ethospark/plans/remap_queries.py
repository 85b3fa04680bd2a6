"""Queries that move labels between the identities of two pose versions."""

from pyspark.sql import functions as F

from ethospark.operators import remap as R
from ethospark.operators.frames import runs
from ethospark.operators.pose import video_lengths
from ethospark.plans.registry import query, rounded

MIN_IOU = 0.75
ANIMAL = ["video", "identity"]


def _pose_blocks(v):
    """Labels on the pose videos: runs of animals looking up or down, with gaps between."""
    rows = v.pose().withColumn("present", F.col("y_0") > 420).filter(F.col("y_0").isNotNull())
    return runs(rows, ANIMAL, ["present"]).select(
        *ANIMAL, F.lit("rear").alias("behavior"), "start", "end", "present"
    )


def _annotations(v):
    """One annotation per block; every second one is about the video as a whole."""
    rows = _pose_blocks(v)
    return rows.select(
        "video", "start", "end", F.when(F.col("present"), "Up").otherwise("up").alias("tag"),
        F.lit("#112233").alias("color"), F.lit(None).cast("string").alias("description"),
        F.when(F.col("start") % 2 == 0, F.col("identity")).alias("identity"),
    )


_BOXES = """
    src AS (SELECT video, instance AS identity, frame,
                   (embedding[37]::DOUBLE + 1) * 400 AS x1, (embedding[38]::DOUBLE + 1) * 400 AS y1,
                   (embedding[37]::DOUBLE + 1) * 400 + (abs(embedding[39]::DOUBLE) + 0.2) * 300 AS x2,
                   (embedding[38]::DOUBLE + 1) * 400 + (abs(embedding[40]::DOUBLE) + 0.2) * 300 AS y2,
                   embedding[41]::DOUBLE * 40 AS dx, embedding[42]::DOUBLE * 40 AS dy
            FROM v_raw_instance),
    dst AS (SELECT video, (identity + 1) % 3 AS identity, frame, x1 + dx AS x1, y1 + dy AS y1,
                   x2 + dx AS x2, y2 + dy AS y2 FROM src),
    ious AS (
        SELECT s.video, s.identity, s.frame, d.identity AS dst,
               greatest(0, least(s.x2, d.x2) - greatest(s.x1, d.x1)) AS w,
               greatest(0, least(s.y2, d.y2) - greatest(s.y1, d.y1)) AS h,
               (s.x2 - s.x1) * (s.y2 - s.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS areas
        FROM src s JOIN dst d USING (video, frame)),
    iou AS (SELECT video, identity, frame, dst, w * h / (areas - w * h) AS iou FROM ious)"""
_BLOCKS = """
    looks AS (SELECT video, identity, frame, y_0 > 420 AS present FROM v_pose WHERE y_0 IS NOT NULL),
    blocks AS (
        SELECT video, identity, min(frame)::INT AS "start", max(frame)::INT AS "end", present
        FROM (SELECT *, frame - row_number() OVER (PARTITION BY video, identity, present ORDER BY frame)
                     AS island FROM looks)
        GROUP BY video, identity, present, island)"""
_SCORES = f"""{_BOXES}, {_BLOCKS},
    scores AS (
        SELECT b.video, b.identity, b."start", b."end", b.present, i.dst, median(i.iou) AS iou
        FROM blocks b JOIN iou i ON i.video = b.video AND i.identity = b.identity
         AND i.frame BETWEEN b."start" AND b."end" GROUP BY ALL),
    best AS (
        SELECT b.*, coalesce(s.dst, (SELECT min(d.identity) FROM dst d WHERE d.video = b.video)) AS dst,
               coalesce(s.iou, 0) AS iou
        FROM blocks b LEFT JOIN (
            SELECT * FROM scores WHERE iou > 0
            QUALIFY row_number() OVER (PARTITION BY video, identity, "start", "end", present
                                       ORDER BY iou DESC, dst) = 1) s
        USING (video, identity, "start", "end", present))"""


@query(
    "remap_box_iou",
    f"WITH {_BOXES} SELECT video, identity, frame, dst AS dst_identity, round(iou, 6) + 0.0 AS iou FROM iou",
)
def remap_box_iou(v):
    src, dst = v.boxes()
    other = dst.select("video", "frame", F.col("identity").alias("dst_identity"), *[F.col(c).alias(f"o_{c}") for c in R.BOX])
    return src.join(other, ["video", "frame"]).select(
        *ANIMAL, "frame", "dst_identity", rounded(R.box_iou()).alias("iou")
    )


@query(
    "remap_interval_scores",
    f"""WITH {_SCORES} SELECT video, identity, "start", "end", dst AS dst_identity, round(iou, 6) + 0.0 AS iou
        FROM scores""",
)
def remap_interval_scores(v):
    blocks = _pose_blocks(v).withColumn("iid", F.struct(*ANIMAL, "start", "end"))
    out = R.interval_scores(blocks, *v.boxes())
    return out.select("iid.*", "dst_identity", rounded("iou").alias("iou"))


@query(
    "remap_best_identity",
    f"""WITH {_SCORES} SELECT video, identity, 'rear' AS behavior, "start", "end", present,
               dst AS dst_identity, round(iou, 6) + 0.0 AS iou, iou >= {MIN_IOU} AS moved FROM best""",
)
def remap_best_identity(v):
    out = _remapped(v)
    return out.select(*R.BLOCK, "dst_identity", rounded("iou").alias("iou"), "moved")


def _remapped(v):
    return R.remap_blocks(_pose_blocks(v), *v.boxes(), MIN_IOU)


_PAINTED = f"""{_SCORES},
    painted AS (
        SELECT video, dst AS identity, identity AS src, "start" AS began,
               unnest(range("start", "end" + 1))::INT AS frame, present::INT AS label
        FROM best WHERE iou >= {MIN_IOU})"""


@query(
    "remap_labels",
    f"""WITH {_PAINTED}
    SELECT video, identity, 'rear' AS behavior, frame, label FROM painted
    QUALIFY row_number() OVER (PARTITION BY video, identity, frame ORDER BY src DESC, began DESC) = 1""",
)
def remap_labels(v):
    return R.remapped_labels(_remapped(v))


@query(
    "remap_failures",
    f"""WITH {_SCORES}
    SELECT DISTINCT video, "start", "end",
           CASE WHEN present THEN 'behavior-remap-failed' ELSE 'not-behavior-remap-failed' END AS tag,
           CASE WHEN present THEN '#FF8800' ELSE '#8888FF' END AS color
    FROM best WHERE iou < {MIN_IOU}""",
)
def remap_failures(v):
    return R.failure_annotations(_remapped(v))


@query(
    "remap_counts",
    f"""WITH {_SCORES}
    SELECT video, count(*) FILTER (iou >= {MIN_IOU} AND identity < 2) AS moved,
           count(*) FILTER (iou < {MIN_IOU} OR identity >= 2) AS skipped FROM best GROUP BY video""",
)
def remap_counts(v):
    """The source poses are said to have two identities, so labels of the third are orphans."""
    counts = v.pose().select("video").distinct().withColumn("num_identities", F.lit(2))
    return R.remap_counts(R.remap_blocks(_pose_blocks(v), *v.boxes(), MIN_IOU, counts))


# a destination whose animals are moved apart, so that all source animals resemble identity 0
_CROWDED = f"""{_BOXES}, {_BLOCKS},
    apart AS (SELECT video, identity, frame, x1 + 300 * identity AS x1, y1, x2 + 300 * identity AS x2, y2 FROM dst),
    pairs AS (
        SELECT s.video, s.identity, s.frame, d.identity AS dst,
               greatest(0, least(s.x2, d.x2) - greatest(s.x1, d.x1))
                 * greatest(0, least(s.y2, d.y2) - greatest(s.y1, d.y1)) AS inter,
               (s.x2 - s.x1) * (s.y2 - s.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS areas
        FROM src s JOIN apart d USING (video, frame)),
    scores AS (
        SELECT b.video, b.identity, b."start", b."end", b.present, i.dst, median(inter / (areas - inter)) AS iou
        FROM blocks b JOIN pairs i ON i.video = b.video AND i.identity = b.identity
         AND i.frame BETWEEN b."start" AND b."end" GROUP BY ALL),
    chosen AS (
        SELECT * FROM scores WHERE iou > 0
        QUALIFY row_number() OVER (PARTITION BY video, identity, "start", "end", present
                                   ORDER BY iou DESC, dst) = 1),
    painted AS (
        SELECT video, dst AS identity, identity AS src, "start" AS began,
               unnest(range("start", "end" + 1))::INT AS frame, present::INT AS label
        FROM chosen WHERE iou >= 0.1)"""


@query(
    "remap_overlap_report",
    f"""WITH {_CROWDED}, earlier AS (
        SELECT *, lag(label) OVER (PARTITION BY video, identity, frame ORDER BY src, began) AS before FROM painted)
    SELECT video, 'rear' AS behavior, src AS src_identity, identity AS dst_identity, began AS "start",
           count(*) FILTER (before = label) AS identical, count(*) FILTER (before <> label) AS conflicting
    FROM earlier WHERE before IS NOT NULL GROUP BY ALL""",
)
def remap_overlap_report(v):
    src, dst = v.boxes()
    apart = dst.withColumns({c: F.col(c) + 300 * F.col("identity") for c in ("x1", "x2")})
    return R.overlap_report(R.remap_blocks(_pose_blocks(v), src, apart, 0.1))


@query(
    "remap_annotations",
    f"""WITH {_SCORES},
    moved AS (
        SELECT video, "start", "end", identity AS src, CASE WHEN present THEN 'Up' ELSE 'up' END AS tag,
               dst AS identity FROM best WHERE "start" % 2 = 0 AND iou >= {MIN_IOU}
        UNION ALL
        SELECT video, "start", "end", NULL, CASE WHEN present THEN 'Up' ELSE 'up' END, NULL
        FROM blocks WHERE "start" % 2 <> 0)
    SELECT video, "start", "end", identity, tag, '#112233' AS color, NULL::VARCHAR AS description FROM moved
    QUALIFY row_number() OVER (PARTITION BY video, "start", "end", identity, lower(tag)
                               ORDER BY src NULLS FIRST, tag) = 1""",
)
def remap_annotations(v):
    return R.remap_annotations(_annotations(v), *v.boxes(), MIN_IOU)


@query(
    "remap_orphan_identities",
    """WITH counts AS (SELECT video, max(identity) - 20 AS n FROM v_length GROUP BY video),
    used AS (SELECT video, identity FROM v_label_block
             UNION SELECT video, identity FROM v_annotation WHERE identity IS NOT NULL)
    SELECT video, identity FROM used JOIN counts USING (video) WHERE identity >= n""",
)
def remap_orphan_identities(v):
    counts = v.lengths().groupBy("video").agg((F.max("identity") - 20).alias("num_identities"))
    return R.orphan_identities(v.label_block(), v.annotation(), counts)


@query(
    "remap_eligible_videos",
    """SELECT video FROM v_pose_length WHERE video NOT IN ('v1', 'v5', 'v8')""",
)
def remap_eligible_videos(v):
    """v1 has an old pose, v5 no boxes on one side, v8 another length."""
    base = video_lengths(v.pose())
    src = base.select(
        "video", F.when(F.col("video") == "v1", 7).otherwise(8).alias("version"),
        F.lit(True).alias("has_boxes"), "num_frames",
    )
    dst = base.select(
        "video", F.lit(8).alias("version"), (F.col("video") != "v5").alias("has_boxes"),
        (F.col("num_frames") + F.when(F.col("video") == "v8", 1).otherwise(0)).alias("num_frames"),
    )
    return R.eligible_videos(src, dst)


@query(
    "remap_import_behaviors",
    """SELECT event_type AS behavior, count(*) AS frames, 'target' AS origin FROM events
       WHERE event_type <> 'signup' GROUP BY event_type
       UNION ALL
       SELECT event_type, count(*), 'source' FROM events WHERE event_type = 'signup' GROUP BY event_type""",
)
def remap_import_behaviors(v):
    counts = v.table("events").groupBy(F.col("event_type").alias("behavior")).agg(F.count(F.lit(1)).alias("frames"))
    target = counts.filter(F.col("behavior") != "signup").withColumn("origin", F.lit("target"))
    return R.import_behaviors(target, counts.withColumn("origin", F.lit("source")))


@query(
    "remap_model_metadata",
    "SELECT 'presence' AS key UNION ALL SELECT 'pose_model_version'",
)
def remap_model_metadata(v):
    """One video lacks metadata and one was made with another model version."""
    videos = v.table("embeddings").select(F.concat(F.lit("v"), F.col("label")).alias("video")).distinct()
    metadata = videos.select(
        "video", F.lit("pose").alias("pose_model_name"),
        F.when(F.col("video") == "v6", "2").otherwise("1").alias("pose_model_version"),
        F.lit("boxes").alias("detection_model_name"), F.lit(None).cast("string").alias("detection_model_version"),
        (F.col("video") != "v9").alias("has_metadata"),
    )
    return R.model_metadata_problems(metadata)
