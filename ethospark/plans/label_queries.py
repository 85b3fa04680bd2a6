"""Label and annotation queries."""

from pyspark.sql import functions as F

from ethospark.operators import labels as L
from ethospark.plans.registry import query, rounded

ANIMAL = ["video", "identity"]
TRACK = L.TRACK
_TRACK = "video, identity, behavior"


def blocks_sql(source: str, key: str = _TRACK) -> str:
    """Label frames → blocks."""
    return f"""
        SELECT {key}, min(frame)::INT AS "start", max(frame)::INT AS "end", label = 1 AS present
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY {key}, label ORDER BY frame) AS island FROM {source})
        GROUP BY {key}, label, island"""


# --- blocks and frames ---


@query(
    "labels_blocks_to_frames",
    """WITH painted AS (
        SELECT video, identity, frame, label, 0 AS layer FROM v_label_a
        UNION ALL SELECT video, identity, frame, label, 1 FROM v_label_b)
    SELECT video, identity, frame, arg_max(label, layer)::INT AS label
    FROM painted GROUP BY video, identity, frame""",
)
def labels_blocks_to_frames(v):
    """Two layers of blocks; the second one overwrites the first where both paint."""
    blocks = v.label_block()
    layered = blocks.withColumn("seq", (F.col("behavior") == "rest").cast("int"))
    return L.blocks_to_frames(layered, ANIMAL, "seq")


@query("labels_frames_to_blocks", blocks_sql("v_label_frame"))
def labels_frames_to_blocks(v):
    return L.frames_to_blocks(v.label_frame())


_EDITS = """
    edits AS (
        SELECT video, identity, "start", "end" + 3 AS "end", "start" AS seq,
               CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 0 ELSE -1 END AS label
        FROM v_event_run WHERE event_type IN ('purchase', 'click', 'error')),
    edit_frames AS (
        SELECT video, identity, unnest(range("start", "end" + 1))::INT AS frame, label, seq
        FROM edits)"""


def _edits(v):
    runs = v.event_run().filter(F.col("event_type").isin("purchase", "click", "error"))
    label = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "click", 0)
    return runs.select(
        *ANIMAL, "start", (F.col("end") + 3).alias("end"), F.col("start").alias("seq"),
        label.otherwise(-1).alias("label"),
    )


@query(
    "labels_edit_ranges",
    f"""WITH {_EDITS},
    layers AS (SELECT video, identity, frame, label, -1 AS seq FROM v_label_b
               UNION ALL SELECT video, identity, frame, label, seq FROM edit_frames),
    latest AS (SELECT video, identity, frame, arg_max(label, seq)::INT AS label
               FROM layers GROUP BY ALL)
    SELECT * FROM latest WHERE label <> -1""",
)
def labels_edit_ranges(v):
    return L.edit(v.label_b(), _edits(v), ANIMAL)


@query(
    "labels_edit_present_only",
    f"""WITH {_EDITS},
    allowed AS (
        SELECT e.* FROM edit_frames e SEMI JOIN v_present p USING (video, identity, frame)
        UNION ALL SELECT * FROM edit_frames WHERE label = -1),
    layers AS (SELECT video, identity, frame, label, -1 AS seq FROM v_label_b
               UNION ALL SELECT video, identity, frame, label, seq FROM allowed),
    latest AS (SELECT video, identity, frame, arg_max(label, seq)::INT AS label
               FROM layers GROUP BY ALL)
    SELECT * FROM latest WHERE label <> -1""",
)
def labels_edit_present_only(v):
    return L.edit(v.label_b(), _edits(v), ANIMAL, v.present())


_FRAGMENTED = f"""
    visible AS (SELECT l.* FROM v_label_frame l SEMI JOIN v_present USING (video, identity, frame)),
    frag AS ({blocks_sql('visible')})"""


@query("labels_fragmented_blocks", f"WITH {_FRAGMENTED} SELECT * FROM frag")
def labels_fragmented_blocks(v):
    return L.fragmented(v.label_frame(), v.present())


@query(
    "labels_slice_blocks",
    """WITH cut AS (SELECT video, identity, behavior, frame - 10 AS frame, label
                    FROM v_label_frame WHERE frame BETWEEN 10 AND 40)"""
    + blocks_sql("cut"),
)
def labels_slice_blocks(v):
    return L.slice_blocks(v.label_block(), 10, 40)


# --- counts ---


@query(
    "labels_bout_counts",
    """SELECT video, identity, behavior, count(*) FILTER (present) AS bouts_behavior,
              count(*) FILTER (NOT present) AS bouts_not
       FROM v_label_block GROUP BY ALL""",
)
def labels_bout_counts(v):
    return L.bout_counts(v.label_block())


# the first three videos play old files that carry the fragmented view only
_OLD = "('video0', 'video1', 'video2')"
_TALLY = """count(*) FILTER (present) AS {0}_bouts_behavior,
    count(*) FILTER (NOT present) AS {0}_bouts_not,
    coalesce(sum("end" - "start" + 1) FILTER (present), 0)::BIGINT AS {0}_frames_behavior,
    coalesce(sum("end" - "start" + 1) FILTER (NOT present), 0)::BIGINT AS {0}_frames_not"""
_COUNTS = f"""{_FRAGMENTED},
    parts AS (SELECT video, identity, behavior, {_TALLY.format('fragmented')} FROM frag GROUP BY ALL),
    whole AS (SELECT video, identity, behavior, {_TALLY.format('unfragmented')}
              FROM v_label_block WHERE video NOT IN {_OLD} GROUP BY ALL),
    counts AS (
        SELECT video, identity, behavior,
               {', '.join(f'coalesce(fragmented_{c}, 0) AS fragmented_{c}' for c in L.COUNT_COLUMNS)},
               {', '.join(
                   f'coalesce(CASE WHEN video IN {_OLD} THEN fragmented_{c} ELSE unfragmented_{c} END, 0)'
                   f' AS unfragmented_{c}' for c in L.COUNT_COLUMNS)}
        FROM whole FULL JOIN parts USING (video, identity, behavior))"""


def _counts(v):
    recent = v.label_block().filter(~F.col("video").isin("video0", "video1", "video2"))
    return L.label_counts(recent, L.fragmented(v.label_frame(), v.present()))


@query("labels_counts", f"WITH {_COUNTS} SELECT * FROM counts")
def labels_counts(v):
    return _counts(v)


@query(
    "labels_included_bout_totals",
    f"""WITH {_COUNTS}
    SELECT behavior, sum(unfragmented_bouts_behavior)::BIGINT AS bouts_behavior,
           sum(unfragmented_bouts_not)::BIGINT AS bouts_not
    FROM counts WHERE video NOT IN ('video2', 'video5') GROUP BY behavior""",
)
def labels_included_bout_totals(v):
    videos = v.num_frames()
    return L.included_bout_totals(_counts(v), videos.filter(F.col("video").isin("video2", "video5")))


# --- down-sampling ---

_SIZE = 16


@query(
    "labels_downsample",
    f"""WITH bins AS (
        SELECT video, identity, num_frames, ceil(num_frames / {_SIZE}.0)::INT AS w,
               unnest(range({_SIZE}))::INT AS bin FROM v_length),
    tallies AS (
        SELECT b.video, b.identity, b.bin, any_value(b.w) AS w, any_value(b.num_frames) AS n,
               count(*) FILTER (l.label = 1) AS yes, count(*) FILTER (l.label = 0) AS no
        FROM bins b LEFT JOIN v_label_b l
          ON l.video = b.video AND l.identity = b.identity AND l.frame // b.w = b.bin
        GROUP BY b.video, b.identity, b.bin)
    SELECT video, identity, bin,
           (CASE WHEN yes > 0 AND no > 0 THEN 2 WHEN yes > 0 THEN 1 WHEN no > 0 THEN 0
                 WHEN (bin + 1) * w <= n THEN -1 ELSE 3 END)::INT AS label
    FROM tallies""",
)
def labels_downsample(v):
    return L.downsample(v.label_b(), v.lengths(), _SIZE, ANIMAL)


@query(
    "labels_class_shares",
    f"""WITH tracks AS (
        SELECT s.video, s.identity, s.frame, coalesce(CASE WHEN m.label = 1 THEN
               CASE m.behavior WHEN 'None' THEN 1 WHEN 'walk' THEN 2 ELSE 3 END END, 0) AS cls
        FROM v_sequence s LEFT JOIN v_label_multi m USING (video, identity, frame)),
    parts AS (
        SELECT t.video, t.identity, b.bin, cls, num_frames / {_SIZE}.0::DOUBLE AS w,
               least(frame + 1, (bin + 1) * num_frames / {_SIZE}.0::DOUBLE)
                 - greatest(frame, bin * num_frames / {_SIZE}.0::DOUBLE) AS overlap
        FROM tracks t JOIN v_length USING (video, identity)
        CROSS JOIN (SELECT unnest(range({_SIZE}))::INT AS bin) b),
    weights AS (
        SELECT video, identity, bin, cls, sum(overlap) AS weight, any_value(w) AS w
        FROM parts WHERE overlap > 1e-9 GROUP BY video, identity, bin, cls),
    totals AS (
        SELECT *, sum(weight) FILTER (cls > 0) OVER (PARTITION BY video, identity, bin) AS labelled
        FROM weights)
    SELECT video, identity, bin, cls::INT AS cls, round(weight / coalesce(labelled, w), 6) AS share
    FROM totals WHERE cls > 0 OR labelled IS NULL""",
)
def labels_class_shares(v):
    track = L.display_track(v.label_multi(), v.lengths(), ["walk", "rest"])
    shares = L.class_shares(L.runs(track, ANIMAL, ["cls"]), v.lengths(), _SIZE, ANIMAL)
    return shares.withColumn("share", rounded("share"))


# --- merging ---


def _merge_query(strategy: str, both: str) -> None:
    @query(
        f"labels_merge_{strategy.lower()}",
        f"""SELECT video, identity, frame,
                   (CASE WHEN a.label IS NULL THEN b.label WHEN b.label IS NULL THEN a.label
                         ELSE {both} END)::INT AS label
            FROM v_label_a a FULL JOIN v_label_b b USING (video, identity, frame)""",
    )
    def run(v):
        return L.merge(v.label_a(), v.label_b(), strategy, ANIMAL)


_merge_query("BEHAVIOR_WINS", "greatest(a.label, b.label)")
_merge_query("NOT_BEHAVIOR_WINS", "least(a.label, b.label)")
_merge_query("DESTINATION_WINS", "a.label")


@query(
    "labels_merge_projects",
    """WITH dst AS (SELECT * FROM v_label_frame WHERE video <> 'video6'),
    src AS (SELECT video, identity, frame, label, 'walk' AS behavior FROM v_label_b
            WHERE video NOT IN ('video0', 'video3')
            UNION ALL
            SELECT video, identity, frame, label, 'groom' FROM v_label_a
            WHERE video NOT IN ('video0', 'video3'))
    SELECT video, identity, behavior, frame,
           (CASE WHEN dst.label IS NULL THEN src.label WHEN src.label IS NULL THEN dst.label
                 ELSE greatest(dst.label, src.label) END)::INT AS label
    FROM dst FULL JOIN src USING (video, identity, behavior, frame)""",
)
def labels_merge_projects(v):
    """Source lacks video0 and has another pose of video3; destination lacks video6."""
    return _merged_projects(v)["labels"]


def _merged_projects(v, longer: str = ""):
    videos = v.num_frames().withColumn("pose_hash", F.md5("video"))
    added = F.when(F.col("video") == longer, 1).otherwise(0)
    behavior = lambda *names: v.spark.createDataFrame([(n,) for n in names], "behavior string")
    changed = F.when(F.col("video") == "video3", F.lit("other")).otherwise(F.col("pose_hash"))
    destination = {
        "videos": videos.filter(F.col("video") != "video6"),
        "behaviors": behavior("walk", "rest"),
        "labels": v.label_frame().filter(F.col("video") != "video6"),
    }
    theirs = v.label_b().withColumn("behavior", F.lit("walk")).unionByName(
        v.label_a().withColumn("behavior", F.lit("groom"))
    )
    source = {
        "videos": videos.withColumns({"pose_hash": changed, "num_frames": F.col("num_frames") + added}).filter("video <> 'video0'"),
        "behaviors": behavior("walk", "groom"),
        "labels": theirs.filter(F.col("video") != "video0"),
    }
    return L.merge_projects(destination, source, "BEHAVIOR_WINS")


@query(
    "labels_merge_project_videos",
    "SELECT video, md5(video) AS pose_hash, num_frames FROM v_num_frames",
)
def labels_merge_project_videos(v):
    return _merged_projects(v)["videos"]


@query(
    "labels_merge_project_skipped",
    """SELECT video, CASE video WHEN 'video3' THEN 'pose differs' ELSE 'length differs' END AS reason
       FROM v_num_frames WHERE video IN ('video2', 'video3')""",
)
def labels_merge_project_skipped(v):
    """One video has another pose, one is a frame longer in the source."""
    return _merged_projects(v, longer="video2")["skipped"]


@query(
    "labels_merge_checked",
    """SELECT video, identity, frame, greatest(a.label, b.label)::INT AS label
       FROM v_label_a a FULL JOIN v_label_b b USING (video, identity, frame)""",
)
def labels_merge_checked(v):
    """With the lengths of both sides compared."""
    return L.merge(v.label_a(), v.label_b(), "BEHAVIOR_WINS", ANIMAL, (v.lengths(), v.lengths()))


# --- several behaviours ---


@query(
    "labels_multiclass",
    """SELECT video, identity, frame,
              (CASE behavior WHEN 'None' THEN 0 WHEN 'walk' THEN 1 ELSE 2 END)::INT AS cls
       FROM v_label_multi WHERE label = 1""",
)
def labels_multiclass(v):
    return L.multiclass_labels(v.label_multi(), ["walk", "rest"])


@query(
    "labels_display_track",
    """SELECT s.video, s.identity, s.frame, coalesce(CASE WHEN m.label = 1 THEN
              CASE m.behavior WHEN 'None' THEN 1 WHEN 'walk' THEN 2 ELSE 3 END END, 0)::INT AS cls
       FROM v_sequence s LEFT JOIN v_label_multi m USING (video, identity, frame)""",
)
def labels_display_track(v):
    return L.display_track(v.label_multi(), v.lengths(), ["walk", "rest"])


@query(
    "labels_overlapping_videos",
    """SELECT DISTINCT video FROM (
        SELECT video FROM v_label_frame WHERE label = 1
        GROUP BY video, identity, frame HAVING count(*) > 1)""",
)
def labels_overlapping_videos(v):
    return L.overlapping_videos(v.label_frame())


_EXCLUSIVE = """
    ranges AS (
        SELECT video, identity, "start", "end" + 2 AS "end", "start" AS seq,
               event_type <> 'click' AS positive,
               CASE WHEN event_type = 'error' THEN 'rest' ELSE 'walk' END AS behavior
        FROM v_event_run WHERE event_type IN ('purchase', 'click', 'error')),
    range_frames AS (
        SELECT video, identity, unnest(range("start", "end" + 1))::INT AS frame, seq, positive,
               behavior FROM ranges)"""


def _exclusive_edits(v):
    rows = v.event_run().filter(F.col("event_type").isin("purchase", "click", "error"))
    return rows.select(
        *ANIMAL, "start", (F.col("end") + 2).alias("end"), F.col("start").alias("seq"),
        (F.col("event_type") != "click").alias("positive"),
        F.when(F.col("event_type") == "error", "rest").otherwise("walk").alias("behavior"),
    )


@query(
    "labels_exclusive_edits",
    f"""WITH {_EXCLUSIVE},
    latest AS (
        SELECT video, identity, frame,
               arg_max(CASE WHEN positive THEN behavior ELSE 'None' END, seq) AS behavior
        FROM range_frames GROUP BY video, identity, frame)
    SELECT video, identity, frame, behavior, 1 AS label FROM latest
    UNION ALL
    SELECT video, identity, frame, behavior, label FROM v_label_multi m
    ANTI JOIN latest USING (video, identity, frame)""",
)
def labels_exclusive_edits(v):
    return L.exclusive_edits(v.label_multi(), _exclusive_edits(v))


@query(
    "labels_binary_edits",
    f"""WITH {_EXCLUSIVE},
    layers AS (
        SELECT video, identity, behavior, frame, label, -1 AS seq FROM v_label_multi
        UNION ALL SELECT video, identity, behavior, frame, positive::INT, seq FROM range_frames)
    SELECT video, identity, behavior, frame, arg_max(label, seq)::INT AS label
    FROM layers GROUP BY video, identity, behavior, frame""",
)
def labels_binary_edits(v):
    return L.exclusive_edits(v.label_multi(), _exclusive_edits(v), multiclass=False)


# --- project level ---


@query(
    "labels_labeled_identities",
    "SELECT DISTINCT video, identity FROM v_label_multi WHERE behavior IN ('rest')",
)
def labels_labeled_identities(v):
    return L.labeled_identities(L.frames_to_blocks(v.label_multi()), ["rest"])


@query(
    "labels_rename_behavior",
    """SELECT video, identity, CASE behavior WHEN 'rest' THEN 'sleep' ELSE behavior END AS behavior,
              "start", "end", present FROM v_label_block""",
)
def labels_rename_behavior(v):
    return L.rename_behavior(v.label_block(), "rest", "sleep")


@query(
    "labels_videos_to_prune",
    """SELECT video, num_frames FROM v_num_frames WHERE video NOT IN
       (SELECT video FROM v_annotation WHERE tag = 'error' AND identity IS NOT NULL
        AND "end" - "start" >= 4)""",
)
def labels_videos_to_prune(v):
    """Videos without a stretch of at least five errors by a known animal."""
    long_errors = v.annotation().filter(
        (F.col("tag") == "error") & F.col("identity").isNotNull() & (F.col("end") - F.col("start") >= 4)
    )
    blocks = long_errors.select("video", "identity", F.col("tag").alias("behavior"), "start", "end")
    return L.videos_to_prune(v.num_frames(), blocks, "error")


@query(
    "labels_archive_behavior",
    """SELECT *, behavior = 'rest' AS archived FROM v_label_block""",
)
def labels_archive_behavior(v):
    live, archived = L.archive_behavior(v.label_block(), "rest")
    return live.withColumn("archived", F.lit(False)).unionByName(
        archived.withColumn("archived", F.lit(True))
    )


@query(
    "labels_bout_at_frame",
    """SELECT e.video, e.identity, b.behavior, e.frame, b."start", b."end", b.present
       FROM v_sequence e JOIN v_label_block b ON b.video = e.video AND b.identity = e.identity
        AND e.frame BETWEEN b."start" AND b."end" AND b.behavior = 'walk'
       WHERE e.event_type = 'purchase'""",
)
def labels_bout_at_frame(v):
    points = v.sequence().filter(F.col("event_type") == "purchase").select(*ANIMAL, "frame")
    points = points.withColumn("behavior", F.lit("walk"))
    return L.bout_at(v.label_block(), points)


# --- annotations ---

_WANTED = """
    wanted AS (SELECT video, "start", "end", upper(tag) AS tag, identity FROM v_annotation
               WHERE "end" > "start")"""


def _wanted(v):
    long_ones = v.annotation().filter(F.col("end") > F.col("start"))
    return long_ones.select("video", "start", "end", F.upper("tag").alias("tag"), "identity")


_MATCH = """EXISTS (SELECT 1 FROM wanted w WHERE w.video = a.video AND w."start" = a."start"
            AND w."end" = a."end" AND lower(w.tag) = lower(a.tag)
            AND w.identity IS NOT DISTINCT FROM a.identity)"""


@query(
    "annotations_find",
    f"""WITH {_WANTED} SELECT video, "start", "end", tag, identity FROM v_annotation a WHERE {_MATCH}""",
)
def annotations_find(v):
    return L.find_annotations(v.annotation(), _wanted(v)).select(
        "video", "start", "end", "tag", "identity"
    )


@query(
    "annotations_delete",
    f"""WITH {_WANTED} SELECT video, "start", "end", tag, identity FROM v_annotation a
        WHERE NOT {_MATCH}""",
)
def annotations_delete(v):
    return L.find_annotations(v.annotation(), _wanted(v), "left_anti").select(
        "video", "start", "end", "tag", "identity"
    )


@query(
    "annotations_in_range",
    """WITH ranges AS (
        SELECT video, lo, least(lo + 9, num_frames - 1)::INT AS hi
        FROM (SELECT video, num_frames, unnest(range(0, num_frames, 10))::INT AS lo FROM v_num_frames))
    SELECT r.video, lo, hi, "start", "end", tag, identity
    FROM ranges r JOIN v_annotation a
      ON a.video = r.video AND a."start" <= r.hi AND a."end" >= r.lo""",
)
def annotations_in_range(v):
    lo = v.num_frames().withColumn(
        "lo", F.explode(F.sequence(F.lit(0), F.col("num_frames") - 1, F.lit(10)))
    )
    ranges = lo.select("video", "lo", F.least(F.col("lo") + 9, F.col("num_frames") - 1).alias("hi"))
    return L.annotations_in(v.annotation(), ranges).select(
        "video", "lo", "hi", "start", "end", "tag", "identity"
    )
