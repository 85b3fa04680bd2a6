"""Keypoint-detector evaluation queries."""

from pyspark.sql import functions as F

from ethospark.operators import keypoint_metrics as M
from ethospark.plans.registry import query, rounded

SIGMAS = [0.3, 0.3, 0.35, 0.4, 0.5]

_XY = ", ".join(
    f"embedding[{2 * k + 1}]::DOUBLE * 100 AS x_{k}, embedding[{2 * k + 2}]::DOUBLE * 100 AS y_{k}, "
    f"(embedding[{50 + k}]::DOUBLE > -0.2)::INT AS v_{k}"
    for k in range(5)
)
_LOW = lambda a: "least(" + ", ".join(f"{a}_{k}" for k in range(5)) + ")"
_HIGH = lambda a: "greatest(" + ", ".join(f"{a}_{k}" for k in range(5)) + ")"
_ROWS = f"""
    vectors AS (
        SELECT (vec_id // 16)::INT AS image, vec_id, (vec_id % 16)::INT AS slot,
               embedding[61]::DOUBLE + 0.5 AS score, embedding[62]::DOUBLE > 0.2 AS crowd, {_XY}
        FROM embeddings),
    boxed AS (SELECT *, {_LOW('x')} AS x1, {_LOW('y')} AS y1, {_HIGH('x')} AS x2, {_HIGH('y')} AS y2 FROM vectors),
    det AS (SELECT * FROM boxed WHERE vec_id % 2 = 0),
    truth AS (SELECT * FROM boxed WHERE vec_id % 2 = 1)"""
_OKS = " + ".join(
    f"""t.v_{k} * exp(-(power(d.x_{k} - t.x_{k}, 2) + power(d.y_{k} - t.y_{k}, 2))
        / (power(2 * {s}, 2) * 2 * (t.x2 - t.x1) * (t.y2 - t.y1) + 2.220446049250313e-16))"""
    for k, s in enumerate(SIGMAS)
)
_VISIBLE = " + ".join(f"t.v_{k}" for k in range(5))
_PAIRS = f"""{_ROWS},
    pairs AS (
        SELECT d.image, d.slot AS det, t.slot AS gt, d.score, t.crowd,
               CASE WHEN {_VISIBLE} > 0 THEN ({_OKS}) / ({_VISIBLE}) ELSE 0 END AS oks,
               greatest(0, least(d.x2, t.x2) - greatest(d.x1, t.x1))
                 * greatest(0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS inter,
               (d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas
        FROM det d JOIN truth t USING (image))"""


@query(
    "metric_oks_pairs",
    f"""WITH {_PAIRS} SELECT image, det, gt, round(score, 6) AS score, crowd, round(oks, 6) + 0.0 AS similarity
        FROM pairs""",
)
def metric_oks_pairs(v):
    return _rounded(M.pair_table(*v.detections(), SIGMAS))


@query(
    "metric_iou_pairs",
    f"""WITH {_PAIRS} SELECT image, det, gt, round(score, 6) AS score, crowd,
               round(CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END, 6) + 0.0 AS similarity
        FROM pairs""",
)
def metric_iou_pairs(v):
    return _rounded(M.pair_table(*v.detections()))


def _rounded(pairs):
    return pairs.withColumns({c: rounded(c) for c in ("score", "similarity")})


# Greedy matching step by step: detections of an image in order of score, one per recursion step.
_LEVELS = ", ".join(f"({t}::DOUBLE)" for t in M.THRESHOLDS)


def _matched(similarity: str, levels: str = _LEVELS) -> str:
    return f"""{_PAIRS},
    levels AS (SELECT * FROM (VALUES {levels}) l(threshold)),
    ranked AS (SELECT image, slot AS det, score,
                      row_number() OVER (PARTITION BY image ORDER BY score DESC, slot) AS r FROM det),
    sims AS (SELECT image, det, gt, crowd, {similarity} AS s FROM pairs),
    steps AS (
        SELECT image, threshold, 0 AS r, [-1] AS used, NULL::INT AS det, NULL::INT AS gt
        FROM (SELECT DISTINCT image FROM ranked) CROSS JOIN levels
        UNION ALL
        SELECT p.image, p.threshold, k.r, list_append(p.used, coalesce(b.gt, -1)), k.det, b.gt
        FROM steps p JOIN ranked k ON k.image = p.image AND k.r = p.r + 1
        LEFT JOIN LATERAL (
            SELECT q.gt FROM sims q WHERE q.image = k.image AND q.det = k.det AND NOT q.crowd
             AND q.s >= p.threshold AND NOT list_contains(p.used, q.gt)
            ORDER BY q.s DESC, q.gt DESC LIMIT 1) b ON TRUE),
    matched AS (
        SELECT s.threshold, s.image, s.det, s.gt, s.gt IS NOT NULL AS tp,
               s.gt IS NULL AND EXISTS (SELECT 1 FROM sims q WHERE q.image = s.image AND q.det = s.det
                                        AND q.crowd AND q.s >= s.threshold) AS ignored,
               k.score
        FROM steps s JOIN ranked k USING (image, det) WHERE s.r > 0)"""


_IOU = "CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END"


def _recursive(sql: str) -> str:
    return f"WITH RECURSIVE {sql}"


@query(
    "metric_greedy_match",
    _recursive(_matched("oks"))
    + " SELECT round(threshold, 6) AS threshold, image, det, gt, tp, ignored FROM matched",
)
def metric_greedy_match(v):
    det, truth = v.detections()
    out = M.greedy_match(M.pair_table(det, truth, SIGMAS), det, M.THRESHOLDS)
    return out.select(rounded("threshold").alias("threshold"), "image", "det", "gt", "tp", "ignored")


def _curve(similarity: str) -> str:
    return f"""{_matched(similarity)},
    total AS (SELECT count(*) AS n FROM truth WHERE NOT crowd),
    curve AS (
        SELECT threshold, sum(tp::INT) OVER w / count(*) OVER w AS precision, sum(tp::INT) OVER w / n::DOUBLE AS recall
        FROM matched CROSS JOIN total WHERE NOT ignored
        WINDOW w AS (PARTITION BY threshold ORDER BY score DESC, image, det ROWS UNBOUNDED PRECEDING)),
    grid AS (SELECT unnest(range(101)) / 100.0::DOUBLE AS r),
    levels_at AS (
        SELECT l.threshold, g.r, coalesce(max(c.precision), 0) AS p
        FROM levels l CROSS JOIN grid g
        LEFT JOIN curve c ON c.threshold = l.threshold AND c.recall >= g.r GROUP BY ALL),
    scored AS (
        SELECT threshold, avg(p) AS ap, coalesce((SELECT max(recall) FROM curve c WHERE c.threshold = a.threshold), 0) AS ar
        FROM levels_at a GROUP BY threshold)"""


_PER_LEVEL = " SELECT round(threshold, 6) AS threshold, round(ap, 6) + 0.0 AS ap, round(ar, 6) + 0.0 AS ar FROM scored"


def _levels(df):
    return df.select(*[rounded(c).alias(c) for c in ("threshold", "ap", "ar")])


@query("metric_pose_ap", _recursive(_curve("oks")) + _PER_LEVEL)
def metric_pose_ap(v):
    return _levels(M.evaluate(*v.detections(), SIGMAS))


@query("metric_box_ap", _recursive(_curve(_IOU)) + _PER_LEVEL)
def metric_box_ap(v):
    return _levels(M.evaluate(*v.detections()))


@query(
    "metric_pose_summary",
    _recursive(_curve("oks"))
    + """ SELECT round(avg(ap), 6) AS ap, round(avg(ar), 6) AS ar,
          round(max(ap) FILTER (threshold = 0.5), 6) AS ap_50, round(max(ap) FILTER (threshold = 0.75), 6) + 0.0 AS ap_75,
          round(max(ar) FILTER (threshold = 0.5), 6) AS ar_50, round(max(ar) FILTER (threshold = 0.75), 6) + 0.0 AS ar_75
          FROM scored""",
)
def metric_pose_summary(v):
    out = M.evaluation_summary(M.evaluate(*v.detections(), SIGMAS))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


def _pck_points() -> str:
    return " UNION ALL ".join(
        f"""SELECT {k} AS keypoint, sqrt(power(d.x_{k} - t.x_{k}, 2) + power(d.y_{k} - t.y_{k}, 2)) AS dist,
                   sqrt(power(t.x2 - t.x1, 2) + power(t.y2 - t.y1, 2)) * 0.3 AS reach
            FROM matched m JOIN det d ON d.image = m.image AND d.slot = m.det
            JOIN truth t ON t.image = m.image AND t.slot = m.gt WHERE t.v_{k} > 0"""
        for k in range(5)
        if k != 2
    )


_PCK = _recursive(_matched("oks", "(0.5::DOUBLE)")) + f""", points AS ({_pck_points()}),
    per_keypoint AS (SELECT keypoint, count(*) FILTER (dist < reach) AS correct, count(*) AS total
                     FROM points WHERE reach > 0 GROUP BY keypoint)"""


@query(
    "metric_pck",
    _PCK + " SELECT keypoint, correct, total, round(correct / total, 6) + 0.0 AS pck FROM per_keypoint",
)
def metric_pck(v):
    out = M.evaluate_pck(*v.detections(), SIGMAS, 0.3, exclude=[2])
    return out.withColumn("pck", rounded("pck"))


@query(
    "metric_pck_overall",
    _PCK + " SELECT round(coalesce(sum(correct) / sum(total), 0), 6) + 0.0 AS pck FROM per_keypoint",
)
def metric_pck_overall(v):
    out = M.pck_overall(M.evaluate_pck(*v.detections(), SIGMAS, 0.3, exclude=[2]))
    return out.select(rounded("pck").alias("pck"))


@query(
    "metric_confidence_labels",
    f"""WITH {_ROWS}
    SELECT d.image, d.slot AS det, k AS keypoint,
           CASE WHEN sqrt(power(list_extract([d.x_0, d.x_1, d.x_2, d.x_3, d.x_4], k + 1)
                                - list_extract([t.x_0, t.x_1, t.x_2, t.x_3, t.x_4], k + 1), 2)
                        + power(list_extract([d.y_0, d.y_1, d.y_2, d.y_3, d.y_4], k + 1)
                                - list_extract([t.y_0, t.y_1, t.y_2, t.y_3, t.y_4], k + 1), 2))
                     <= 0.1 * sqrt(80000) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
    FROM det d JOIN truth t ON t.image = d.image AND t.slot = d.slot + 1
    CROSS JOIN (SELECT unnest(range(5))::INT AS k) ks""",
)
def metric_confidence_labels(v):
    """Each detection against the ground truth listed next to it; images are 200 x 200."""
    det, truth = v.detections()
    g = truth.select("image", (F.col("gt") - 1).alias("det"), F.col("points").alias("truth"))
    labels = M.confidence_labels(F.col("points"), F.col("truth"), 80000.0**0.5, 0.1)
    return det.join(g, ["image", "det"]).select("image", "det", F.posexplode(labels).alias("keypoint", "label"))
