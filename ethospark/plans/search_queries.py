"""Search, sampling and missing-keypoint queries."""

from pyspark.sql import functions as F

from ethospark.operators import search as S
from ethospark.operators.frames import runs
from ethospark.plans.registry import query, rounded
from ethospark.skeleton import KEYPOINTS, TRAINING_SEED

_HIT = """video AS file, identity::VARCHAR AS identity, behavior, "start" AS start_frame, "end" AS end_frame"""


@query(
    "search_labels_positive",
    f"SELECT {_HIT} FROM v_label_block WHERE present AND behavior = 'rest'",
)
def search_labels_positive(v):
    return S.search_labels(v.label_block(), "rest")


@query("search_labels_any", f"SELECT {_HIT} FROM v_label_block")
def search_labels_any(v):
    return S.search_labels(v.label_block(), None, True, True)


def _runs_sql(condition: str, keep: str = "TRUE") -> str:
    return f"""
        WITH hits AS (SELECT video, identity, behavior, frame FROM v_scored WHERE {condition}),
        found AS (
            SELECT video, identity, behavior, min(frame) AS "start", max(frame) AS "end"
            FROM (SELECT *, frame - row_number() OVER
                            (PARTITION BY video, identity, behavior ORDER BY frame) AS island FROM hits)
            GROUP BY video, identity, behavior, island)
        SELECT {_HIT} FROM found WHERE {keep}"""


@query("search_predictions_positive", _runs_sql("cls = 1", '"end" - "start" + 1 BETWEEN 2 AND 4'))
def search_predictions_positive(v):
    return S.search_predictions(v.prediction(), "positive", shortest=2, longest=4)


@query("search_predictions_negative", _runs_sql("cls = 0 AND behavior = 'walk'"))
def search_predictions_negative(v):
    return S.search_predictions(v.prediction(), "negative", "walk")


@query(
    "search_predictions_range",
    _runs_sql("cls IN (0, 1) AND confidence >= 0.255 AND confidence <= 0.755"),
)
def search_predictions_range(v):
    return S.search_predictions(v.prediction(), "range", at_least=0.255, at_most=0.755)


@query(
    "search_confidence",
    "SELECT video, identity, behavior, frame, cls, round(confidence, 6) AS confidence FROM v_scored",
)
def search_confidence(v):
    return v.prediction().select(
        "video", "identity", "behavior", "frame", "cls", rounded(S.search_confidence()).alias("confidence")
    )


@query(
    "search_annotations",
    """SELECT video AS file, identity::VARCHAR AS identity, NULL::VARCHAR AS behavior,
              "start" AS start_frame, "end" AS end_frame
       FROM v_annotation WHERE tag = 'purchase' AND "end" - "start" + 1 BETWEEN 1 AND 2""",
)
def search_annotations(v):
    return S.search_annotations(v.annotation(), "purchase", 1, 2)


@query("search_ordered_hits", f"SELECT {_HIT} FROM v_label_block WHERE present AND behavior = 'walk'")
def search_ordered_hits(v):
    return S.ordered_hits(S.search_labels(v.label_block(), "walk"))


# --- sampling ---


def _bouts(v):
    states = v.state().filter(F.col("state") == 1)
    return runs(states, ["video", "identity"], ["state"]).select("video", "identity", "start", "end")


@query(
    "sample_per_bout",
    f"""WITH islands AS (
            SELECT video, identity, frame, frame - row_number() OVER (PARTITION BY video, identity ORDER BY frame) AS island
            FROM v_state WHERE state = 1),
        named AS (SELECT *, min(frame) OVER (PARTITION BY video, identity, island) AS bout_start FROM islands),
        drawn AS (
            SELECT video, frame, row_number() OVER (PARTITION BY video, identity, bout_start
                ORDER BY md5(concat_ws('|', {TRAINING_SEED}, video, identity, bout_start, frame)), frame) AS place
            FROM named)
        SELECT DISTINCT video, frame FROM drawn WHERE place = 1""",
)
def sample_per_bout(v):
    return S.sample_per_bout(_bouts(v), 1)


@query(
    "sample_all_of_short_bouts",
    """SELECT DISTINCT video, frame FROM v_state WHERE state = 1""",
)
def sample_all_of_short_bouts(v):
    """With a limit no bout reaches, the sample is every bout frame once."""
    return S.sample_per_bout(_bouts(v), 1000)


@query(
    "sample_total",
    f"""SELECT video, frame FROM (SELECT DISTINCT video, frame FROM v_state WHERE state = 1)
        ORDER BY md5(concat_ws('|', {TRAINING_SEED}, video, frame)), video, frame LIMIT 100""",
)
def sample_total(v):
    return S.sample_total(_bouts(v), 100)


@query(
    "sample_total_count",
    """SELECT least(100, count(*)) AS frames, least(100, count(*)) AS in_bouts
       FROM (SELECT DISTINCT video, frame FROM v_state WHERE state = 1)""",
)
def sample_total_count(v):
    """How many frames the sample has, and how many of them lie in a bout."""
    pool = v.state().filter(F.col("state") == 1).select("video", "frame").distinct().withColumn("_in", F.lit(True))
    drawn = S.sample_total(_bouts(v), 100).join(pool, ["video", "frame"], "left")
    return drawn.agg(F.count(F.lit(1)).alias("frames"), F.count("_in").alias("in_bouts"))


# --- missing keypoints: bouts are stretches of animals with a high nose ---

_NOSE = """
    bout_frames AS (SELECT video, identity, frame FROM v_pose WHERE y_0 > 400),
    bouts AS (
        SELECT video, identity, min(frame) AS "start", max(frame) AS "end"
        FROM (SELECT *, frame - row_number() OVER (PARTITION BY video, identity ORDER BY frame) AS island
              FROM bout_frames)
        GROUP BY video, identity, island)"""


def _pose_bouts(v):
    high = v.pose().filter(F.col("y_0") > 400).select("video", "identity", "frame")
    return runs(high, ["video", "identity"], []).select("video", "identity", "start", "end")


_RATES = ", ".join(f"avg((x_{k} IS NULL)::INT) AS m_{k}" for k in range(12))
_PER_BOUT = f"""{_NOSE},
    per_bout AS (
        SELECT b.video, b.identity, b."start", b."end", count(*) AS duration, {_RATES}
        FROM bouts b JOIN v_pose p ON p.video = b.video AND p.identity = b.identity
         AND p.frame BETWEEN b."start" AND b."end" GROUP BY ALL)"""


@query(
    "missing_keypoints_per_bout",
    f"""WITH {_PER_BOUT} SELECT video, identity, "start", "end", duration, """
    + ", ".join(f'round(m_{k}, 6) + 0.0 AS "missing_{n}"' for k, n in enumerate(KEYPOINTS))
    + " FROM per_bout",
)
def missing_keypoints_per_bout(v):
    out = S.missing_per_bout(_pose_bouts(v), v.pose())
    return out.withColumns({f"missing_{n}": rounded(f"missing_{n}") for n in KEYPOINTS})


@query(
    "missing_keypoints_summary",
    f"WITH {_PER_BOUT} "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS keypoint, round(sum(m_{k} * duration) / sum(duration), 6) AS overall,
                   round(avg(m_{k}), 6) AS bout_mean, round(stddev_pop(m_{k}), 6) AS bout_std,
                   round(median(m_{k}), 6) AS bout_median FROM per_bout"""
        for k, n in enumerate(KEYPOINTS)
    ),
)
def missing_keypoints_summary(v):
    out = S.missing_summary(S.missing_per_bout(_pose_bouts(v), v.pose()))
    return out.select("keypoint", *[rounded(c).alias(c) for c in ("overall", "bout_mean", "bout_std", "bout_median")])


_SEEN = " + ".join(f"(x_{k} IS NOT NULL)::INT" for k in range(12))
_MISSING = f"""{_NOSE},
    seen AS (SELECT video, identity, frame, {_SEEN} AS n FROM v_pose),
    counts AS (SELECT video, max(identity) + 1 AS ids FROM v_pose GROUP BY video),
    rates AS (
        SELECT b.video, b.frame, b.identity, (12 - s.n) / 12.0::DOUBLE AS missing,
               (12 * (ids - 1) - (SELECT sum(o.n) FROM seen o WHERE o.video = b.video AND o.frame = b.frame) + s.n)
                 / (12.0::DOUBLE * (ids - 1)) AS others_missing
        FROM bout_frames b JOIN seen s USING (video, identity, frame) JOIN counts USING (video)),
    worst AS (
        SELECT video, frame, missing, others_missing FROM rates
        QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY missing DESC, identity) = 1)"""


@query(
    "missing_keypoints_frames",
    f"""WITH {_MISSING}
    SELECT video, frame, round(missing, 6) + 0.0 AS missing, round(others_missing, 6) + 0.0 AS others_missing
    FROM worst WHERE missing >= 0.08""",
)
def missing_keypoints_frames(v):
    out = S.missing_frames(_pose_bouts(v), v.pose(), 0.08)
    return out.select("video", "frame", rounded("missing").alias("missing"), rounded("others_missing").alias("others_missing"))


@query(
    "missing_keypoints_top_frames",
    f"""WITH RECURSIVE {_MISSING},
    ranked AS (SELECT *, row_number() OVER (ORDER BY missing DESC, video, frame) AS i FROM worst WHERE missing >= 0.08),
    steps AS (
        SELECT 0::BIGINT AS i, CAST([] AS STRUCT(v VARCHAR, f INT)[]) AS chosen
        UNION ALL
        SELECT r.i, CASE WHEN len(s.chosen) < 20
                     AND len(list_filter(s.chosen, lambda c: c.v = r.video AND abs(c.f - r.frame) < 3)) = 0
                    THEN list_append(s.chosen, {{'v': r.video, 'f': r.frame}}) ELSE s.chosen END
        FROM steps s JOIN ranked r ON r.i = s.i + 1),
    kept AS (SELECT c.v AS video, c.f AS frame FROM (
        SELECT unnest(chosen) AS c FROM (SELECT chosen FROM steps ORDER BY i DESC LIMIT 1)))
    SELECT video, frame, round(missing, 6) + 0.0 AS missing, round(others_missing, 6) + 0.0 AS others_missing
    FROM worst JOIN kept USING (video, frame)""",
)
def missing_keypoints_top_frames(v):
    out = S.top_frames(S.missing_frames(_pose_bouts(v), v.pose(), 0.08), 20, 3)
    return out.select("video", "frame", rounded("missing").alias("missing"), rounded("others_missing").alias("others_missing"))
