"""Scoring keypoint detectors: similarity, matching, AP/AR, PCK.

``detection``: (image, det, score, points, x1…y2); ``ground_truth``: (image, gt, crowd, points,
visible, x1…y2, optional area). ``points`` are arrays of (x, y).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.frames import number_frames
from ethospark.session import ensure_checkpoint_dir

# Thresholds 0.50, 0.55 … 0.95 and 101 recall levels.
THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]
RECALL_GRID = [float(r) for r in np.linspace(0.0, 1.0, 101)]



def _point_distance_squared(a: Column, b: Column) -> Column:
    return F.zip_with(
        a, b, lambda p, q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])
    )


def oks(points: Column, truth: Column, visible: Column, area: Column, sigmas: Sequence[float]) -> Column:
    """Object keypoint similarity; 0 without visible points or area."""
    eps = float(np.finfo(float).eps)
    widths = F.array(*[F.lit((2 * float(s)) ** 2 * 2) for s in sigmas])
    squared = _point_distance_squared(points, truth)
    terms = F.zip_with(squared, widths, lambda d, w: F.exp(-d / (w * area + eps)))
    shown = F.zip_with(terms, visible, lambda t, v: F.when(v > 0, t).otherwise(0.0))
    n = F.size(F.filter(visible, lambda v: v > 0))
    total = F.aggregate(shown, F.lit(0.0), lambda s, t: s + t)
    return F.when((n > 0) & (area > 0), total / n).otherwise(F.lit(0.0))


def box_iou() -> Column:
    """IoU of the detection box (x1…) and the ground-truth box (g_x1…)."""
    width = lambda p: F.greatest(F.lit(0.0), F.col(p + "x2") - F.col(p + "x1"))
    height = lambda p: F.greatest(F.lit(0.0), F.col(p + "y2") - F.col(p + "y1"))
    w = F.greatest(F.lit(0.0), F.least("x2", "g_x2") - F.greatest("x1", "g_x1"))
    h = F.greatest(F.lit(0.0), F.least("y2", "g_y2") - F.greatest("y1", "g_y1"))
    union = width("") * height("") + width("g_") * height("g_") - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def pair_table(
    detection: DataFrame, truth: DataFrame, sigmas: Sequence[float] | None = None
) -> DataFrame:
    """(image, det, gt, score, crowd, similarity): OKS with ``sigmas``, else box IoU.

    One row per detection and ground truth of the same image, as the operator defines it; the
    matching below reads only pairs at or above its lowest threshold.
    """
    area = F.col("area") if "area" in truth.columns else (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    g = truth.select(
        "image", "gt", "crowd", F.col("points").alias("g_points"), "visible", area.alias("g_area"),
        *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")],
    )
    pairs = detection.join(g, "image")
    if sigmas is None:
        value = box_iou()
    else:
        value = oks(F.col("points"), F.col("g_points"), F.col("visible"), F.col("g_area"), sigmas)
    return pairs.select("image", "det", "gt", "score", "crowd", value.alias("similarity"))


# --- matching ---------------------------------------------------------------------------------

MATCH = ["threshold", "image", "det"]
PART = 4096  # detections of an image that one task matches


def _candidates(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Pairs at or above each threshold."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        pairs.filter(F.col("similarity") >= min(thresholds))
        .withColumn("threshold", F.explode(F.filter(levels, lambda t: t <= F.col("similarity"))))
    )


def _in_parts(pairs: DataFrame) -> DataFrame:
    """Add ``_rank`` (ascending: best score first) and ``_part``: ``PART`` detections of an image by score."""
    worst_last = "CASE WHEN isnan(score) THEN -double('inf') ELSE coalesce(-score, double('inf')) END"
    ranked = pairs.withColumn("_rank", F.expr(worst_last))
    detections = ranked.select("image", "det", "_rank").distinct()
    cell = "CAST(floor(greatest(least(_rank, 1e9), -1e9) * 1024) AS BIGINT)"
    numbered = number_frames(detections, ["image"], ["_rank", "det"], cell, "_part")
    numbered = numbered.withColumn("_part", F.floor(F.col("_part") / PART).cast("int"))
    return ranked.join(numbered.select("image", "det", "_part"), ["image", "det"])


def _proposals(pairs: DataFrame) -> DataFrame:
    """The greedy matching inside every part, as if there were no other: (threshold, image, det, _rank, gt)."""
    names = ["threshold", "image", "_part", "det", "_rank", "gt"]
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    out = ["threshold", "image", "det", "_rank", "gt"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, proposing, taken, found = None, None, set(), []
        for batch in batches:
            for threshold, image, part, det, rank, gt in zip(*(batch[n].tolist() for n in names)):
                if (threshold, image, part) != unit:
                    unit, proposing, taken = (threshold, image, part), None, set()
                if det != proposing and gt not in taken:
                    taken.add(gt)
                    proposing = det
                    found.append((threshold, image, det, rank, gt))
            yield pd.DataFrame(found, columns=out)
            found = []

    ordered = pairs.repartition("threshold", "image", "_part").sortWithinPartitions(
        "threshold", "image", "_part", "_rank", "det", F.desc("similarity"), F.desc("gt")
    )
    return ordered.select(*names).mapInPandas(stream, ", ".join(f"{n} {kinds[n]}" for n in out))


def _match_in_parts(open_pairs: DataFrame) -> DataFrame:
    """Greedy matching, whatever the size of an image.

    The detections of an image are cut into parts by score. Every part settles its own conflicts in
    one pass; a ground truth that several parts want keeps the proposal with the highest score, and its pairs with
    weaker detections are struck, which propose again. Since all ground truths rank detections
    alike, this ends in exactly the greedy result. The first part of an image is final after one round, the
    second after two at most, and so on; images without a refusal leave after the round.
    """
    ensure_checkpoint_dir(open_pairs.sparkSession)
    unit = ["threshold", "image"]
    strongest = Window.partitionBy(*unit, "gt").orderBy("_rank", "det")
    pairs, final = _in_parts(open_pairs).checkpoint(), []
    while True:
        judged = _proposals(pairs).withColumn("_r", F.row_number().over(strongest)).checkpoint()
        again = judged.filter("_r > 1").select(*unit).distinct()
        if again.isEmpty():
            return reduce(DataFrame.unionByName, [*final, judged.select(*MATCH, "gt")])
        final.append(judged.join(again, unit, "left_anti").select(*MATCH, "gt"))
        held = judged.filter("_r = 1").select(*unit, "gt", F.struct("_rank", "det").alias("_held"))
        left = pairs.join(again, unit, "left_semi").join(held, [*unit, "gt"], "left")
        pairs = left.filter(F.col("_held").isNull() | (F.struct("_rank", "det") <= F.col("_held"))).drop("_held").checkpoint()


def greedy_match(
    pairs: DataFrame, detection: DataFrame, thresholds: Sequence[float]
) -> DataFrame:
    """Match detections to ground truths per image and threshold.

    By descending score (then detection order) each detection takes the free ground truth with
    the highest similarity at or above the threshold, the last one on ties. An unmatched detection
    that reaches a crowd region is ignored. Returns every detection with ``gt`` (NULL if unmatched),
    ``tp`` and ``ignored``.
    """
    near = _candidates(pairs, thresholds)
    plain = near.filter(~F.col("crowd"))
    matched = _match_in_parts(plain.select("threshold", "image", "det", "gt", "score", "similarity"))
    absorbed = near.filter("crowd").select(*MATCH).distinct().withColumn("_crowd", F.lit(True))
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    every = detection.select(F.explode(levels).alias("threshold"), "image", "det", "score")
    return (
        every.join(matched, MATCH, "left").join(absorbed, MATCH, "left")
        .withColumn("tp", F.col("gt").isNotNull())
        .withColumn("ignored", ~F.col("tp") & F.coalesce("_crowd", F.lit(False)))
        .drop("_crowd")
    )


# --- average precision and recall -----------------------------------------------------------------


def precision_recall(matches: DataFrame, total_gt: int, parts: int | None = None) -> DataFrame:
    """Precision and recall after each detection in order of score, per threshold.

    The order is global, so the detections are range partitioned on it, every part counts its hits,
    and the counts of the earlier parts (a row per part and threshold) are added.
    """
    spark = matches.sparkSession
    ensure_checkpoint_dir(spark)
    order = [F.desc("score"), F.asc("image"), F.asc("det")]
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = matches.filter(~F.col("ignored")).select(
        "threshold", "score", "image", "det", F.col("tp").cast("int").alias("hit")
    )
    # written down once: the part numbers must not change between the two uses below
    ranged = counted.repartitionByRange(n, "threshold", *order).withColumn(
        "_part", F.spark_partition_id()
    ).checkpoint()
    sums = ranged.groupBy("threshold", "_part").agg(F.sum("hit").alias("_h"), F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("threshold").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "threshold", "_part",
        F.coalesce(F.sum("_h").over(earlier), F.lit(0)).alias("_hits_before"),
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    here = Window.partitionBy("threshold", "_part").orderBy(*order)
    local = ranged.withColumns({
        "_hits": F.sum("hit").over(here.rowsBetween(Window.unboundedPreceding, 0)),
        "_rows": F.row_number().over(here),
    })
    hits = F.col("_hits") + F.col("_hits_before")
    return local.join(offsets, ["threshold", "_part"]).select(
        "threshold", "score", "image", "det",
        (hits / (F.col("_rows") + F.col("_rows_before"))).alias("precision"),
        (hits / F.lit(float(total_gt))).alias("recall"),
    )


def average_precision(matches: DataFrame, total_gt: int) -> DataFrame:
    """AP and AR per threshold.

    AP averages, over 101 recall levels, the best precision at that recall or beyond. Each point is
    first reduced to the highest level it reaches, which leaves at most 101 rows per threshold.
    """
    if total_gt == 0:
        return matches.select("threshold").distinct().select(
            "threshold", F.lit(0.0).alias("ap"), F.lit(0.0).alias("ar")
        )
    curve = precision_recall(matches, total_gt)
    grid = F.array(*[F.lit(r) for r in RECALL_GRID])
    guess = F.least(F.floor(F.col("recall") * 100).cast("int"), F.lit(100))
    level = (
        F.when(F.coalesce(F.get(grid, guess + 1) <= F.col("recall"), F.lit(False)), guess + 1)
        .when(F.get(grid, guess) > F.col("recall"), guess - 1)
        .otherwise(guess)
    )
    reached = curve.groupBy("threshold", level.alias("level")).agg(
        F.max("precision").alias("best"), F.max("recall").alias("recall")
    )
    beyond = Window.partitionBy("threshold").orderBy("level").rowsBetween(0, Window.unboundedFollowing)
    below = Window.partitionBy("threshold").orderBy("level")
    envelope = reached.withColumns({
        "best": F.max("best").over(beyond),
        "_previous": F.coalesce(F.lag("level").over(below), F.lit(-1)),
    })
    per_threshold = envelope.groupBy("threshold").agg(
        (F.sum(F.col("best") * (F.col("level") - F.col("_previous"))) / len(RECALL_GRID)).alias("ap"),
        F.max("recall").alias("ar"),
    )
    every = matches.select("threshold").distinct()
    return every.join(per_threshold, "threshold", "left").na.fill(0.0, ["ap", "ar"])


def evaluate(
    detection: DataFrame, truth: DataFrame, sigmas: Sequence[float] | None = None,
    thresholds: Sequence[float] = tuple(THRESHOLDS),
) -> DataFrame:
    """AP and AR per threshold: pose evaluation with ``sigmas``, box evaluation without."""
    if detection.isEmpty() and truth.isEmpty():
        raise ValueError("nothing to evaluate")
    matches = greedy_match(pair_table(detection, truth, sigmas), detection, thresholds)
    total = truth.filter(~F.col("crowd")).count()
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    every = detection.sparkSession.range(1).select(F.explode(levels).alias("threshold"))
    found = average_precision(matches, total)
    return every.join(found, "threshold", "left").na.fill(0.0, ["ap", "ar"])


def evaluation_summary(per_threshold: DataFrame) -> DataFrame:
    """Mean over the thresholds and the values at 0.50 and 0.75."""
    at = lambda c, t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col(c)))
    return per_threshold.agg(
        *[F.avg(c).alias(c) for c in ("ap", "ar")],
        *[at(c, t).alias(f"{c}_{int(t * 100)}") for c in ("ap", "ar") for t in (0.5, 0.75)],
    )


# --- correct keypoints ------------------------------------------------------------------------------


def pck(
    matches: DataFrame, detection: DataFrame, truth: DataFrame, threshold: float,
    exclude: Sequence[int] = (),
) -> DataFrame:
    """Correct and total keypoints per index: distance < threshold x diagonal of the true box.

    ``matches`` come from one matching threshold; crowd regions are never matched.
    """
    g = truth.select(
        "image", "gt", F.col("points").alias("g_points"), "visible",
        (F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * threshold).alias("reach"),
    )
    pairs = (
        matches.filter("tp").select("image", "det", "gt")
        .join(detection.select("image", "det", "points"), ["image", "det"])
        .join(g, ["image", "gt"])
        .filter(F.col("reach") > 0)
    )
    each = F.zip_with(
        _point_distance_squared(F.col("points"), F.col("g_points")), F.col("visible"),
        lambda d, v: F.struct(F.sqrt(d).alias("d"), v.alias("v")),
    )
    points = pairs.select("reach", F.posexplode(each).alias("keypoint", "p")).filter("p.v > 0")
    if exclude:
        points = points.filter(~F.col("keypoint").isin(*exclude))
    return points.groupBy("keypoint").agg(
        F.count_if(F.col("p.d") < F.col("reach")).alias("correct"), F.count(F.lit(1)).alias("total")
    ).withColumn("pck", F.col("correct") / F.col("total"))


def pck_overall(per_keypoint: DataFrame) -> DataFrame:
    total = F.sum("total")
    return per_keypoint.agg(F.coalesce(F.sum("correct") / F.when(total > 0, total), F.lit(0.0)).alias("pck"))


def evaluate_pck(
    detection: DataFrame, truth: DataFrame, sigmas: Sequence[float], threshold: float,
    exclude: Sequence[int] = (), match_threshold: float = 0.5,
) -> DataFrame:
    """PCK per keypoint over the pairs that match at an OKS threshold."""
    matches = greedy_match(pair_table(detection, truth, sigmas), detection, [match_threshold])
    return pck(matches, detection, truth, threshold, exclude)


def confidence_labels(
    predicted: Column, truth: Column, diagonal: Column | float, fraction: float = 0.003
) -> Column:
    """1.0 per keypoint within ``fraction`` of the image diagonal, else 0.0."""
    limit = (diagonal if isinstance(diagonal, Column) else F.lit(float(diagonal))) * fraction
    return F.transform(
        _point_distance_squared(predicted, truth),
        lambda d: F.when(F.sqrt(d) <= limit, 1.0).otherwise(0.0),
    )
