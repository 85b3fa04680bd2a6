"""Bout queries: encode, decode, validate, delete, clean up."""

from pyspark.sql import functions as F

from ethospark.operators import bouts as B
from ethospark.plans.registry import query, rounded

KEYS = ["video", "identity"]

_FRAMES_FROM_BOUTS = """
    SELECT video, identity, unnest(range("start", "end" + 1))::INT AS frame, state FROM {0}"""


@query(
    "bouts_encode",
    """SELECT video, identity, bout_id, "start", duration, state FROM v_bout""",
)
def bouts_encode(v):
    return B.numbered(B.encode(v.state(), KEYS), KEYS).select(
        *KEYS, "bout_id", "start", "duration", "state"
    )


@query("bouts_decode", "SELECT video, identity, frame, state FROM v_state")
def bouts_decode(v):
    return B.decode(B.encode(v.state(), KEYS), KEYS)


# every third bout is damaged in one of three ways, so each rule has violations to find
_DAMAGED = """
    SELECT video, identity, bout_id,
           CASE WHEN bout_id % 9 = 3 THEN "start" + 1 ELSE "start" END AS "start",
           duration,
           CASE WHEN bout_id % 9 = 6 THEN 0 ELSE state END AS state
    FROM v_bout"""


@query(
    "bouts_violations",
    f"""WITH damaged AS ({_DAMAGED}),
    pairs AS (
        SELECT *, lag("start") OVER w AS s0, lag("start" + duration) OVER w AS e0,
               lag(state) OVER w AS st0
        FROM damaged WINDOW w AS (PARTITION BY video, identity ORDER BY bout_id))
    SELECT video, identity, bout_id, "start", duration, state,
           CASE WHEN duration <= 0 THEN 'empty' WHEN "start" <= s0 THEN 'not ascending'
                WHEN "start" <> e0 THEN 'gap or overlap' ELSE 'repeated state' END AS problem
    FROM pairs
    WHERE duration <= 0 OR "start" <= s0 OR "start" <> e0 OR state = st0""",
)
def bouts_violations(v):
    bouts = B.numbered(B.encode(v.state(), KEYS), KEYS)
    damaged = bouts.withColumns({
        "start": F.col("start") + F.when(F.col("bout_id") % 9 == 3, 1).otherwise(0),
        "state": F.when(F.col("bout_id") % 9 == 6, 0).otherwise(F.col("state")),
    })
    return B.violations(damaged, KEYS)


def delete_sql(source: str, flag: str) -> str:
    """Frame-wise statement of bout deletion: each frame takes its new owner's state."""
    return f"""
        SELECT video, identity, unnest(range("start", "end" + 1))::INT AS frame,
               "start" AS s, duration AS d, state, p, n, {flag} AS gone
        FROM (SELECT *, lag(state) OVER w AS p, lead(state) OVER w AS n FROM {source}
              WINDOW w AS (PARTITION BY video, identity ORDER BY "start"))"""


OWNER = """CASE WHEN NOT gone OR (p IS NULL AND n IS NULL) THEN state
                WHEN p IS NULL THEN n WHEN n IS NULL THEN p
                WHEN frame < s + d // 2 THEN p ELSE n END"""


def bouts_sql(source: str, key: str = "video, identity") -> str:
    """Frames → bouts by the islands trick."""
    return f"""
        SELECT {key}, min(frame) AS "start", max(frame) AS "end",
               (max(frame) - min(frame) + 1)::INT AS duration, state
        FROM (SELECT *, frame - row_number() OVER
                        (PARTITION BY {key}, state ORDER BY frame) AS island FROM {source})
        GROUP BY {key}, state, island"""


def chain_sql(steps: list[str]) -> str:
    """CTE chain b0 → b1 → … applying one deletion rule after another; ends in f<n>."""
    ctes = ["b0 AS (SELECT * FROM v_bout)"]
    for i, flag in enumerate(steps):
        ctes.append(f"d{i} AS ({delete_sql(f'b{i}', flag)})")
        ctes.append(f"f{i} AS (SELECT video, identity, frame, ({OWNER})::INT AS state FROM d{i})")
        ctes.append(f"b{i + 1} AS ({bouts_sql(f'f{i}')})")
    return "WITH " + ",\n".join(ctes)


@query(
    "bouts_delete",
    chain_sql(["state = 0 AND duration % 2 = 1"])
    + """ SELECT video, identity, "start", duration, state FROM b1""",
)
def bouts_delete(v):
    gone = (F.col("state") == 0) & (F.col("duration") % 2 == 1)
    return B.delete(B.encode(v.state(), KEYS), KEYS, gone).select(
        *KEYS, "start", "duration", "state"
    )


# frames of a sequence in reverse; each flagged bout is settled with its current neighbours
_SETTLE = """WITH RECURSIVE flagged AS (
        SELECT *, duration <= 1 AND (state <> 0 OR "start" % 2 = 0) AS gone,
               count(*) OVER (PARTITION BY video, identity) AS n FROM v_bout),
    -- lists over the bouts of a sequence: start and state of those not yet visited stay as they are
    steps AS (
        SELECT video, identity, n AS i, CAST([] AS STRUCT(s INT, e INT, st INT)[]) AS done,
               NULL::INT AS reach
        FROM flagged WHERE bout_id = 0
        UNION ALL
        SELECT t.video, t.identity, t.i - 1,
               CASE WHEN NOT f.gone OR (f.bout_id = 0 AND len(t.done) = 0)
                      THEN list_prepend({'s': f."start", 'e': coalesce(t.reach, f."end"), 'st': f.state}, t.done)
                    WHEN f.bout_id = 0
                      THEN list_prepend({'s': f."start", 'e': t.done[1].e, 'st': t.done[1].st}, t.done[2:])
                    WHEN len(t.done) = 0 THEN t.done
                    WHEN b.state = t.done[1].st THEN t.done[2:]
                    ELSE list_prepend({'s': b."end" + (coalesce(t.reach, f."end") - f."start" + 1) // 2 + 1,
                                       'e': t.done[1].e, 'st': t.done[1].st}, t.done[2:]) END,
               CASE WHEN NOT f.gone OR f.bout_id = 0 THEN NULL
                    WHEN len(t.done) = 0 THEN coalesce(t.reach, f."end")
                    WHEN b.state = t.done[1].st THEN t.done[1].e
                    ELSE b."end" + (coalesce(t.reach, f."end") - f."start" + 1) // 2 END
        FROM steps t JOIN flagged f ON f.video = t.video AND f.identity = t.identity AND f.bout_id = t.i - 1
        LEFT JOIN flagged b ON b.video = t.video AND b.identity = t.identity AND b.bout_id = t.i - 2
        WHERE t.i > 0)
    SELECT video, identity, u.s AS "start", (u.e - u.s + 1)::INT AS duration, u.st AS state
    FROM (SELECT video, identity, unnest(done) AS u FROM steps WHERE i = 0)"""


@query("bouts_delete_touching", _SETTLE)
def bouts_delete_touching(v):
    """Single-frame bouts of any state: many of them touch."""
    gone = (F.col("duration") <= 1) & ((F.col("state") != 0) | (F.col("start") % 2 == 0))
    return B.delete_touching(B.encode(v.state(), KEYS), KEYS, gone).select(
        *KEYS, "start", "duration", "state"
    )


def _stage(name: str, flag: str, stage: B.Stage) -> None:
    @query(
        name, chain_sql([flag]) + " SELECT video, identity, frame, state FROM f0"
    )
    def run(v):
        return B.decode(stage(B.encode(v.state(), KEYS), KEYS), KEYS)


_stage("bouts_interpolate_gaps", "state = -1 AND duration <= 2", B.interpolate_gaps(2))
_stage("bouts_stitch", "state = 0 AND duration <= 3", B.stitch(3))
_stage("bouts_drop_short", "state = 1 AND duration < 3", B.drop_short(3))

CONFIG = [
    {"stage_name": "GapInterpolationStage", "parameters": {"max_interpolation_gap": 2}},
    {"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 3}},
    {"stage_name": "BoutDurationFilterStage", "parameters": {"min_duration": 4}},
    {"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 50}, "enabled": False},
]
_RULES = ["state = -1 AND duration <= 2", "state = 0 AND duration <= 3", "state = 1 AND duration < 4"]


@query(
    "bouts_clean_predictions",
    chain_sql(_RULES)
    + """ SELECT s.video, s.identity, s.frame, s.state AS cls, f2.state AS cls_post
          FROM v_state s JOIN f2 USING (video, identity, frame)""",
)
def bouts_clean_predictions(v):
    return B.clean_predictions(v.state().withColumnRenamed("state", "cls"), KEYS, CONFIG)


_REST = """
    rest_state AS (SELECT video, identity, frame, cls AS state FROM v_prediction
                   WHERE behavior = 'rest')"""


@query(
    "bouts_clean_by_behavior",
    chain_sql(_RULES)
    + f""", {_REST}, r0 AS ({bouts_sql('rest_state')}),
      rd AS ({delete_sql('r0', 'state = 1 AND duration < 2')}),
      rf AS (SELECT video, identity, frame, ({OWNER})::INT AS state FROM rd)
      SELECT 'walk' AS behavior, p.video, p.identity, p.frame, p.cls, round(p.prob, 6) AS prob,
             f2.state AS cls_post
      FROM v_prediction p JOIN f2 USING (video, identity, frame) WHERE p.behavior = 'walk'
      UNION ALL
      SELECT 'rest', p.video, p.identity, p.frame, p.cls, round(p.prob, 6), rf.state
      FROM v_prediction p JOIN rf USING (video, identity, frame) WHERE p.behavior = 'rest'""",
)
def bouts_clean_by_behavior(v):
    short = [{"stage_name": "BoutDurationFilterStage", "parameters": {"min_duration": 2}}]
    return B.clean_by_behavior(v.prediction(), KEYS, {"walk": CONFIG, "rest": short}).withColumn(
        "prob", rounded("prob")
    )


@query(
    "bouts_summary",
    chain_sql(_RULES)
    + """ SELECT video, identity, count(*)::BIGINT AS bouts, sum(duration)::BIGINT AS frames,
                 max(duration)::INT AS longest, round(avg(duration), 6) AS mean_duration
          FROM b3 WHERE state = 1 GROUP BY video, identity""",
)
def bouts_summary(v):
    """Cleaned behaviour bouts per animal: the flagship query."""
    clean = B.clean_bouts(B.encode(v.state(), KEYS), KEYS, CONFIG)
    return (
        clean.filter(F.col("state") == B.BEHAVIOR)
        .groupBy(*KEYS)
        .agg(
            F.count(F.lit(1)).alias("bouts"),
            F.sum("duration").cast("bigint").alias("frames"),
            F.max("duration").cast("int").alias("longest"),
            rounded(F.avg("duration")).alias("mean_duration"),
        )
    )
