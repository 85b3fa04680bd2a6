"""Source and sink queries: file names, ear-tag tables, documents, stored tables, clips."""

from pyspark.sql import functions as F

from ethospark.functions import names as N
from ethospark.operators import labels as L
from ethospark.operators import search as SE
from ethospark.operators.frames import lookup_join
from ethospark.operators.pose import video_lengths
from ethospark.plans.label_queries import _FRAGMENTED
from ethospark.plans.registry import query, rounded
from ethospark.plans.search_queries import _PER_BOUT, _pose_bouts
from ethospark.session import scratch_folder
from ethospark.skeleton import KEYPOINTS, TRAINING_SEED
from ethospark.sources import annotations as A
from ethospark.sources import poses as P
from ethospark.sources import tables as T

ANIMAL = ["video", "identity"]
FRAME = [*ANIMAL, "frame"]

# --- file names ---

_FILES = """
    files AS (
        SELECT 'cage_' || (user_id % 7) || '_' || user_id AS video, v AS version,
               '/data/cage_' || (user_id % 7) || '_' || user_id || '_pose_est_v' || v || '.h5' AS path
        FROM (SELECT DISTINCT user_id, unnest(range(2, 3 + user_id % 7)) AS v FROM events))"""


@query("source_pose_file_names", f"WITH {_FILES} SELECT path, video, version::INT AS version FROM files")
def source_pose_file_names(v):
    return P.pose_files(v.file_names())


@query(
    "source_latest_pose_files",
    f"""WITH {_FILES} SELECT video, max(version)::INT AS version, arg_max(path, version) AS path
        FROM files GROUP BY video""",
)
def source_latest_pose_files(v):
    return P.latest_pose_files(v.file_names())


@query(
    "names_safe",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '[^\w.-]+', '_', 'g'), '_{2,}', '_', 'g'), '_')
               AS safe FROM pages""",
)
def names_safe(v):
    return v.table("pages").select("page_id", N.safe_name(F.col("url")).alias("safe"))


# --- ear tags ---

_CODE = """CASE event_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN '00' WHEN 2 THEN ' 01' WHEN 3 THEN NULL
           ELSE ' ' || event_type END"""


def _eartags(v):
    """Detections: the frame is the event's place in its sequence, the tag its type, some invalid."""
    code = (
        F.when(F.col("event_id") % 8 == 0, "  ").when(F.col("event_id") % 8 == 1, "00")
        .when(F.col("event_id") % 8 == 2, " 01").when(F.col("event_id") % 8 != 3, F.concat(F.lit(" "), "event_type"))
    )
    value, number = F.col("value"), (F.col("event_id") % 500).cast("double")
    points = {}
    for k in range(1, 6):
        points[f"kpt_{k}_x"] = F.when(F.col("event_id") % 7 != k, value + k)
        points[f"kpt_{k}_y"] = number + k / 4
    box = {
        "bb_left": value, "bb_top": number, "bb_right": value + 10,
        "bb_bottom": F.when(F.col("event_id") % 5 != 0, number + 10),
    }
    rows = v.sequence().withColumn("video", F.concat(F.lit("m"), F.col("identity")))
    return rows.withColumns({"eartag_code": code, **points, **box})


@query(
    "source_eartag_poses",
    f"""WITH raw AS (
        SELECT 'm' || identity AS video, frame, event_id, value, (event_id % 500)::DOUBLE AS number,
               trim(coalesce({_CODE}, '')) AS tag FROM v_sequence),
    lengths AS (SELECT video, max(frame) + 1 AS n FROM raw GROUP BY video),
    tags AS (SELECT video, tag, row_number() OVER (PARTITION BY video ORDER BY tag) - 1 AS identity
             FROM (SELECT DISTINCT video, tag FROM raw WHERE tag NOT IN ('', '00', '01'))),
    dense AS (SELECT t.video, t.identity, t.tag, unnest(range(n)) AS frame FROM tags t JOIN lengths USING (video))
    SELECT d.video, d.identity::INT AS identity, d.frame::INT AS frame,
           (CASE WHEN r.tag IS NULL THEN 1 ELSE 0 END)::INT AS id_mask,
           (CASE WHEN r.tag IS NULL THEN 0 ELSE d.identity + 1 END)::INT AS embed_id,
           CASE WHEN r.event_id % 7 <> 1 THEN trunc(value + 1) ELSE 0 END AS nose_x,
           CASE WHEN r.event_id % 7 <> 4 THEN trunc(number + 1) ELSE 0 END AS tail_y,
           CASE WHEN r.event_id % 7 <> 5 THEN 1.0::DOUBLE ELSE 0 END AS tip_conf,
           0.0::DOUBLE AS neck_conf, round(coalesce(value, -1)::FLOAT::DOUBLE, 4) AS x1,
           CASE WHEN r.event_id % 5 <> 0 THEN number + 10 ELSE -1 END AS y2
    FROM dense d LEFT JOIN raw r ON r.video = d.video AND r.tag = d.tag AND r.frame = d.frame""",
)
def source_eartag_poses(v):
    rows = _eartags(v)
    out = P.eartag_poses(rows, video_lengths(rows))
    point = lambda k: F.get("keypoints", F.lit(k))
    return out.select(
        *FRAME, "id_mask", "embed_id", point(0)["x"].alias("nose_x"), point(9)["y"].alias("tail_y"),
        point(11)["conf"].alias("tip_conf"), point(3)["conf"].alias("neck_conf"),
        rounded("x1", 4).alias("x1"), "y2",
    )


@query(
    "source_lixit_objects",
    """SELECT 'm' || vec_id AS video, 'lixit' AS object, (k // 3)::INT AS instance, (k % 3)::INT AS point,
              round(embedding[2 * k + 1]::DOUBLE, 6) AS x, round(embedding[2 * k + 2]::DOUBLE, 6) AS y
       FROM embeddings CROSS JOIN (SELECT unnest(range(6)) AS k) ks""",
)
def source_lixit_objects(v):
    pair = lambda k: F.array(
        F.element_at("embedding", 2 * k + 1).cast("double"), F.element_at("embedding", 2 * k + 2).cast("double")
    )
    summary = v.table("embeddings").select(
        F.concat(F.lit("m"), F.col("vec_id")).alias("video"), F.array(*[pair(k) for k in range(6)]).alias("keypoints")
    )
    return P.lixit_objects(summary).withColumns({"x": rounded("x"), "y": rounded("y")})


# --- documents ---


def _documents(v):
    blocks = v.label_block()
    return A.write_documents(blocks, L.fragmented(v.label_frame(), v.present()), v.num_frames())


@query(
    "source_document_parts",
    """SELECT video, identity, behavior, "start", "end", present,
              (row_number() OVER (PARTITION BY video ORDER BY "start", "end", identity, behavior) - 1) // 3 AS part
       FROM v_label_block""",
)
def source_document_parts(v):
    """Written in parts of three blocks and read back: the blocks as drawn, each with its part."""
    fragmented = L.fragmented(v.label_frame(), v.present())
    parts = A.write_document_parts(v.label_block(), fragmented, v.num_frames(), size=3)
    path = scratch_folder(v.spark, "document-parts")
    parts.write.parquet(path)
    blocks = A.load_blocks(A.parse_documents(v.spark.read.parquet(path)))
    return blocks.withColumn("part", F.shiftright("position", 31)).drop("position")


@query("source_document_blocks", 'SELECT video, identity, behavior, "start", "end", present FROM v_label_block')
def source_document_blocks(v):
    """Written to JSON and read back: the blocks as drawn."""
    return A.load_blocks(A.parse_documents(_documents(v))).drop("position")


@query("source_document_fragmented", f"WITH {_FRAGMENTED} SELECT * FROM frag")
def source_document_fragmented(v):
    return A.load_blocks(A.parse_documents(_documents(v)), False).drop("position")


def _annotation_texts(v):
    """JSON lists of one annotation per event; tags and fields go wrong in different ways."""
    tag = (
        F.when(F.col("event_id") % 6 == 0, F.concat("event_type", F.lit(" !")))
        .when(F.col("event_id") % 6 == 1, F.repeat("event_type", 9))
        .when(F.col("event_id") % 6 == 2, F.lit("")).otherwise(F.concat("event_type", F.lit("_é-1")))
    )
    color = F.when(F.col("event_id") % 5 != 0, F.lit("#123456"))
    entry = F.struct(
        F.col("event_id").cast("int").alias("start"), (F.col("event_id") + 3).cast("int").alias("end"),
        tag.alias("tag"), color.alias("color"), F.col("user_id").cast("int").alias("identity"),
    )
    return v.table("events").select(F.lit("one").alias("video"), F.to_json(F.array(entry)).alias("json"))


_ANNOTATIONS = """
    raw AS (
        SELECT event_id::INT AS "start", (event_id + 3)::INT AS "end", user_id::INT AS identity,
               CASE event_id % 6 WHEN 0 THEN event_type || ' !' WHEN 1 THEN repeat(event_type, 9)
                    WHEN 2 THEN '' ELSE event_type || '_é-1' END AS tag,
               CASE WHEN event_id % 5 <> 0 THEN '#123456' END AS color FROM events),
    judged AS (
        SELECT *, CASE WHEN color IS NULL THEN 'missing field' WHEN length(tag) NOT BETWEEN 1 AND 32 THEN 'tag length'
                       WHEN tag LIKE '% !' THEN 'tag characters' END AS reason FROM raw)"""


@query(
    "source_annotations_accepted",
    f"""WITH {_ANNOTATIONS} SELECT 'one' AS video, "start", "end", tag, color, NULL::VARCHAR AS description, identity
        FROM judged WHERE reason IS NULL""",
)
def source_annotations_accepted(v):
    return A.load_annotations(_annotation_texts(v))[0]


@query(
    "source_annotations_rejected",
    f'WITH {_ANNOTATIONS} SELECT "start", tag, reason FROM judged WHERE reason IS NOT NULL',
)
def source_annotations_rejected(v):
    return A.load_annotations(_annotation_texts(v))[1].select("start", "tag", "reason")


# --- stored tables (written, then read back) ---


@query("sink_features", "SELECT video, identity, frame, value AS \"signal value\" FROM v_signal")
def sink_features(v):
    path = scratch_folder(v.spark, "features")
    table = v.signal().withColumnRenamed("value", "signal value").withColumn("zz other", F.lit(1.0))
    T.write_features(table, path, 5)
    return T.read_features(v.spark, path, ["signal value"])


@query(
    "source_feature_status",
    """WITH lengths AS (SELECT video, identity, num_frames AS n FROM v_length)
    SELECT video, identity, md5(video) AS pose_hash, 0.05::DOUBLE AS scale,
           CASE WHEN n % 10 = 0 THEN 'absent' WHEN n % 9 = 0 THEN 'version' WHEN n % 8 = 0 THEN 'pose'
                WHEN n % 7 = 0 THEN 'scale' ELSE 'valid' END AS status FROM lengths""",
)
def source_feature_status(v):
    n = F.col("num_frames")
    meta = v.lengths().filter(n % 10 != 0).select(
        *ANIMAL, F.when(n % 9 == 0, 16).otherwise(17).alias("feature_version"),
        F.when(n % 8 == 0, "old").otherwise(F.md5("video")).alias("pose_hash"),
        F.when(n % 7 != 0, F.lit(0.05)).alias("scale"),
    )
    wanted = v.lengths().select(*ANIMAL, F.md5("video").alias("pose_hash"), F.lit(0.05).alias("scale"))
    return T.feature_status(wanted, meta)


@query(
    "sink_predictions",
    """SELECT video, identity, frame, behavior, CASE WHEN behavior = 'rest' THEN 9 ELSE cls END AS cls
       FROM v_prediction""",
)
def sink_predictions(v):
    """Two behaviours are written, then one of them again with other classes."""
    path = scratch_folder(v.spark, "predictions")
    rows = v.prediction()
    T.write_predictions(rows, path)
    T.write_predictions(rows.filter(F.col("behavior") == "rest").withColumn("cls", F.lit(9)), path)
    return T.read_predictions(v.spark, path).select(*FRAME, "behavior", "cls")


@query(
    "source_predictions",
    """SELECT video, identity, frame, behavior, cls FROM v_prediction
       WHERE behavior = 'walk' AND video <> 'video4'""",
)
def source_predictions(v):
    """One behaviour; a video whose identity count is wrong is left out."""
    path = scratch_folder(v.spark, "predictions")
    T.write_predictions(v.prediction(), path)
    return T.read_predictions(v.spark, path, "walk", identities=_expected_identities(v)).select(*FRAME, "behavior", "cls")


def _expected_identities(v):
    extra = F.when(F.col("video") == "video4", 1).otherwise(0)
    counts = v.lengths().groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("video", (F.col("n") + extra).alias("num_identities"))


@query(
    "source_unread_predictions",
    """SELECT video, behavior, count(DISTINCT identity) AS found,
              CASE WHEN video <> 'video2' THEN count(DISTINCT identity) + 1 END AS num_identities
       FROM v_prediction WHERE video IN ('video2', 'video4') GROUP BY video, behavior""",
)
def source_unread_predictions(v):
    """What the scan leaves out: a video with another number of identities, and one that is not known."""
    path = scratch_folder(v.spark, "predictions")
    T.write_predictions(v.prediction(), path)
    return T.unread_predictions(v.spark, path, _expected_identities(v).filter("video <> 'video2'"))


@query(
    "sink_training_set",
    """SELECT video, identity, frame, value, label, 'rest' AS behavior, 'Random Forest' AS learner
       FROM v_signal JOIN v_label_b USING (video, identity, frame)""",
)
def sink_training_set(v):
    path = scratch_folder(v.spark, "training")
    rows = v.signal().join(v.label_b(), FRAME)
    T.write_training_set(
        v.spark, path, rows, v.lengths(), {"balance_labels": True, "window_size": 5}, "rest", "Random Forest", 7, 5
    )
    stored = T.read_training_set(v.spark, path)
    settings = stored["settings"].select("set_id", F.element_at("behaviors", 1).alias("behavior"), "learner")
    return lookup_join(stored["rows"], settings, ["set_id"], "inner").drop("set_id")


@query(
    "source_training_settings",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Random Forest' WHEN 1 THEN 'XGBoost' ELSE 'CatBoost' END AS learner,
              CASE WHEN event_id % 2 = 0 THEN 'CM' ELSE 'PIXEL' END AS distance_unit FROM events""",
)
def source_training_settings(v):
    code = F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "3").otherwise("CatBoost")
    unit = F.when(F.col("event_id") % 2 == 0, "CM")
    old = v.table("events").select("event_id", code.alias("learner"), unit.alias("distance_unit"))
    return T.normalize_training_settings(old)


def _keypoints(v):
    rows = v.raw_instance().select("video", F.col("instance").alias("identity"), "frame", "keypoints")
    sure = F.aggregate("keypoints", F.lit(0.0), lambda s, p: s + p["conf"]) / 12
    return T.frame_keypoints(rows, F.col("keypoints"), sure)


_SURE = "(" + " + ".join(f"conf_{k}" for k in range(12)) + ") / 12"


@query(
    "source_frame_keypoints",
    f"""SELECT video, instance AS identity, frame::BIGINT AS frame_index, 12 AS points,
               round(rx_3, 6) AS neck_x, round(ry_3, 6) AS neck_y, round({_SURE}, 6) AS confidence
        FROM v_raw_instance""",
)
def source_frame_keypoints(v):
    path = scratch_folder(v.spark, "keypoints")
    _keypoints(v).write.parquet(path)
    neck = F.get("keypoints", F.lit(3))
    return v.spark.read.parquet(path).select(
        *ANIMAL, "frame_index", F.size("keypoints").alias("points"), rounded(F.get(neck, F.lit(0))).alias("neck_x"),
        rounded(F.get(neck, F.lit(1))).alias("neck_y"), rounded("confidence").alias("confidence"),
    )


@query(
    "source_keypoint_annotations",
    f"""SELECT video, instance AS identity, count(*)::INT AS kept, min(frame)::BIGINT AS first_frame,
               round(avg(rx_0), 6) AS nose_x, round(avg(ry_11), 6) AS tip_y, round(avg({_SURE}), 6) AS mean_confidence
        FROM v_raw_instance WHERE {_SURE} >= 0.48 GROUP BY video, instance""",
)
def source_keypoint_annotations(v):
    out = T.keypoint_annotations(_keypoints(v), 0.48)
    at = lambda k, a: F.get(F.get("keypoints", F.lit(k)), F.lit(a))
    return out.select(
        *ANIMAL, F.size("kept_frame_indices").alias("kept"), F.get("kept_frame_indices", F.lit(0)).alias("first_frame"),
        rounded(at(0, 0)).alias("nose_x"), rounded(at(11, 1)).alias("tip_y"), rounded("mean_confidence").alias("mean_confidence"),
    )


@query(
    "source_keypoint_annotation_parts",
    f"""WITH kept AS (SELECT *, {_SURE} AS sure FROM v_raw_instance WHERE {_SURE} >= 0.48),
        whole AS (SELECT video, instance, avg(rx_0) AS nose_x, avg(ry_11) AS tip_y, avg(sure) AS sure
                  FROM kept GROUP BY video, instance)
        SELECT k.video, k.instance AS identity, (frame // 8)::BIGINT AS part, count(*)::INT AS kept,
               min(frame)::BIGINT AS first_frame, max(frame)::BIGINT AS last_frame, round(any_value(w.nose_x), 6) AS nose_x,
               round(any_value(w.tip_y), 6) AS tip_y, round(any_value(w.sure), 6) AS mean_confidence
        FROM kept k JOIN whole w ON w.video = k.video AND w.instance = k.instance
        GROUP BY k.video, k.instance, frame // 8""",
)
def source_keypoint_annotation_parts(v):
    out = T.keypoint_annotation_parts(_keypoints(v), 0.48, size=8)
    at = lambda k, a: F.get(F.get("keypoints", F.lit(k)), F.lit(a))
    return out.select(
        *ANIMAL, "part", F.size("kept_frame_indices").alias("kept"), F.array_min("kept_frame_indices").alias("first_frame"),
        F.array_max("kept_frame_indices").alias("last_frame"), rounded(at(0, 0)).alias("nose_x"),
        rounded(at(11, 1)).alias("tip_y"), rounded("mean_confidence").alias("mean_confidence"),
    )


@query(
    "source_inference_runs",
    """SELECT 'video' || label AS path, count(*) AS frame_count, 'uniform' AS strategy, 256 AS input_width,
              '{"label":' || label || '}' AS extra FROM embeddings GROUP BY label""",
)
def source_inference_runs(v):
    """One run record per label, written and read back."""
    records = v.table("embeddings").groupBy("label").count().selectExpr(
        "named_struct('path', concat('video', label), 'width', 800, 'height', 800, 'fps', 30D, 'frame_count', count) AS video",
        """named_struct('checkpoint_path', 'model', 'backbone', 'net', 'num_keypoints', 12, 'input_size', array(256, 256),
            'output_stride', 4, 'decode_use_dark', true, 'decode_sigma', 2D) AS model""",
        "named_struct('num_frames', 5, 'frame_indices', sequence(0, 4), 'strategy', 'uniform') AS sampling",
        "named_struct('confidence_threshold', 0.5D, 'confidence_metric', 'mean', 'method', 'mean') AS aggregation",
        "CAST(NULL AS STRING) AS created_at", "named_struct('label', label) AS extra",
    )
    path = scratch_folder(v.spark, "runs")
    T.inference_runs(records).write.parquet(path)
    return v.spark.read.parquet(path).select(
        "video.path", "video.frame_count", "sampling.strategy",
        F.get("model.input_size", F.lit(0)).alias("input_width"), "extra",
    )


@query(
    "sink_bout_report",
    f"""WITH {_PER_BOUT} SELECT video, identity::VARCHAR AS identity, "start"::VARCHAR AS start_frame,
            "end"::VARCHAR AS end_frame, duration::VARCHAR AS duration, """
    + ", ".join(f"printf('%.6f', m_{k}) AS {n.lower()}_missing_pct" for k, n in enumerate(KEYPOINTS))
    + ", printf('%.6f', ("
    + " + ".join(f"m_{k}" for k in range(12))
    + ") / 12) AS overall_missing_pct FROM per_bout",
)
def sink_bout_report(v):
    path = scratch_folder(v.spark, "report")
    T.write_csv(T.bout_report(SE.missing_per_bout(_pose_bouts(v), v.pose())), path)
    return v.spark.read.option("header", True).csv(path)


# --- clips ---


@query(
    "source_clip_frames",
    """SELECT video, identity, (frame - 9)::INT AS frame, value FROM v_signal
       WHERE frame BETWEEN 9 AND 68 AND video IN (SELECT video FROM v_num_frames WHERE num_frames >= 69)""",
)
def source_clip_frames(v):
    starts = P.clip_starts(v.num_frames(), 60, 10)
    return P.clip_frames(v.signal(), starts, 60)


@query(
    "source_clip_samples",
    """WITH samples AS (
        SELECT video, identity, frame, value FROM v_sequence
        WHERE event_type = 'purchase' AND video IN (SELECT video FROM v_num_frames WHERE num_frames >= 69)),
    carried AS (SELECT * FROM samples WHERE frame < 9
                QUALIFY row_number() OVER (PARTITION BY video, identity ORDER BY frame DESC) = 1)
    SELECT video, identity, 0 AS sample_frame, 1 AS n, value AS x FROM carried
    UNION ALL
    SELECT video, identity, frame - 9, 1, value FROM samples WHERE frame BETWEEN 9 AND 68""",
)
def source_clip_samples(v):
    starts = P.clip_starts(v.num_frames(), 60, 10)
    return P.clip_samples(v.dynamic_object(), starts, 60, ANIMAL)


@query(
    "source_clip_random_starts",
    f"""SELECT video, (('0x' || left(md5(concat_ws('|', {TRAINING_SEED}, video)), 15))::BIGINT % (num_frames - 19))::INT AS clip_start
        FROM v_num_frames WHERE num_frames >= 20""",
)
def source_clip_random_starts(v):
    return P.clip_starts(v.num_frames(), 20)
