"""Searching labels, predictions and annotations, and sampling frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.operators.frames import (
    exact_median,
    frames_of,
    lookup_join,
    piece_of,
    runs,
    seeded_draw,
    smallest_per_group,
)
from ethospark.operators.pose import POINTS
from ethospark.skeleton import KEYPOINTS, TRAINING_SEED

HIT = ["file", "identity", "behavior", "start_frame", "end_frame"]


def _hits(rows: DataFrame, behavior: Column) -> DataFrame:
    return rows.select(
        F.col("video").alias("file"), F.col("identity").cast("string").alias("identity"),
        behavior.alias("behavior"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"),
    )


def search_labels(
    blocks: DataFrame, behavior: str | None = None, positive: bool = True, negative: bool = False
) -> DataFrame:
    """Label blocks of one behaviour (or any) that are positive and/or negative."""
    found = blocks if behavior is None else blocks.filter(F.col("behavior") == behavior)
    wanted = (F.lit(positive) & F.col("present")) | (F.lit(negative) & ~F.col("present"))
    return _hits(found.filter(wanted), F.col("behavior"))


def search_confidence(cls: str = "cls", prob: str = "prob") -> Column:
    """Confidence that the behaviour shows, 0…1; exactly even predictions lean to their class."""
    nudged = F.col(prob) + float(np.finfo(float).eps)
    value = F.when(F.col(cls) == 0, 1 - nudged).otherwise(nudged)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def _length_between(shortest: int | None, longest: int | None) -> Column:
    length = F.col("end") - F.col("start") + 1
    ok = F.lit(True)
    if shortest is not None:
        ok = ok & (length >= shortest)
    return ok if longest is None else ok & (length <= longest)


def search_predictions(
    predictions: DataFrame,
    kind: str = "positive",
    behavior: str | None = None,
    at_least: float | None = None,
    at_most: float | None = None,
    shortest: int | None = None,
    longest: int | None = None,
) -> DataFrame:
    """Maximal runs of frames that are ``positive``, ``negative`` or in a confidence ``range``."""
    rows = predictions if behavior is None else predictions.filter(F.col("behavior") == behavior)
    if kind == "positive":
        ok = F.col("cls") == 1
    elif kind == "negative":
        ok = F.col("cls") == 0
    elif kind == "range":
        ok = F.col("cls").isin(0, 1)
        if at_least is not None:
            ok = ok & (search_confidence() >= at_least)
        if at_most is not None:
            ok = ok & (search_confidence() <= at_most)
    else:
        raise ValueError(f"unsupported search kind {kind!r}")
    found = runs(rows.filter(ok).select("video", "identity", "behavior", "frame"), ["video", "identity", "behavior"], [])
    return _hits(found.filter(_length_between(shortest, longest)), F.col("behavior"))


def search_annotations(
    annotations: DataFrame, tag: str | None = None, shortest: int | None = None, longest: int | None = None
) -> DataFrame:
    """Timeline annotations by tag and length."""
    found = annotations if tag is None else annotations.filter(F.col("tag") == tag)
    return _hits(found.filter(_length_between(shortest, longest)), F.lit(None).cast("string"))


def ordered_hits(hits: DataFrame) -> DataFrame:
    """Hits by file, start and identity: as numbers if all identities are, else as text."""
    number = F.expr("try_cast(identity AS INT)")
    # one row: does any identity fail to be a number?
    textual = not hits.filter(number.isNull()).isEmpty()
    identity = F.coalesce("identity", F.lit("")) if textual else number
    return hits.orderBy("file", "start_frame", identity, "behavior")


# --- sampling ---------------------------------------------------------------------------------


def _shuffled(frames: DataFrame, seed: int) -> DataFrame:
    return frames.withColumn("_draw", seeded_draw(seed, frames.columns))


def sample_per_bout(bouts: DataFrame, frames_per_bout: int, seed: int = TRAINING_SEED) -> DataFrame:
    """At most so many random frames of each (video, identity, start, end) bout; distinct frames."""
    keys = ["video", "identity", "bout_start"]
    named = bouts.select("video", "identity", F.col("start").alias("bout_start"), "start", "end")
    drawn = _shuffled(frames_of(named).select(*keys, "frame"), seed)
    few = smallest_per_group(drawn, keys, ["_draw", "frame"], frames_per_bout, piece_of("frame"))
    return few.select("video", "frame").distinct()


def sample_total(bouts: DataFrame, num_frames: int, seed: int = TRAINING_SEED) -> DataFrame:
    """So many random frames out of all bout frames."""
    pool = frames_of(bouts.select("video", "start", "end")).distinct()
    return _shuffled(pool, seed).orderBy("_draw", "video", "frame").limit(num_frames).drop("_draw")


# --- missing keypoints --------------------------------------------------------------------------


def _seen(prefix: str = "ok_") -> list[Column]:
    return [F.coalesce(F.col(f"{prefix}{k}").cast("int"), F.lit(0)) for k in POINTS]


def missing_per_bout(bouts: DataFrame, pose: DataFrame) -> DataFrame:
    """Share of a bout's frames on which each keypoint is missing (``missing_<keypoint>``)."""
    keys = ["video", "identity", "start", "end"]
    frames = frames_of(bouts.select("video", "identity", F.col("start").alias("s"), F.col("end").alias("e"), "start", "end"))
    masks = pose.select("video", "identity", "frame", *[f"ok_{k}" for k in POINTS])
    joined = frames.join(masks, ["video", "identity", "frame"], "left").withColumnsRenamed({"s": "start", "e": "end"})
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("duration"),
        *[(1 - F.avg(s)).alias(f"missing_{n}") for s, n in zip(_seen(), KEYPOINTS)],
    )


def missing_summary(per_bout: DataFrame) -> DataFrame:
    """Per keypoint: frame-weighted rate, and mean, median, standard deviation over bouts."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("keypoint"), F.col(f"missing_{n}").alias("missing")) for n in KEYPOINTS
    ])
    long = per_bout.select("duration", F.explode(pairs).alias("p")).select("duration", "p.*")
    stats = long.groupBy("keypoint").agg(
        (F.sum(F.col("missing") * F.col("duration")) / F.sum("duration")).alias("overall"),
        F.avg("missing").alias("bout_mean"),
        F.stddev_pop("missing").alias("bout_std"),
    )
    medians = exact_median(long, ["keypoint"], "missing").withColumnRenamed("median", "bout_median")
    return stats.join(medians, "keypoint")


def missing_frames(
    bouts: DataFrame, pose: DataFrame, threshold: float, expected: int = 12, min_identities: int = 1
) -> DataFrame:
    """Bout frames on which the labelled animal misses at least ``threshold`` of its keypoints.

    ``others_missing`` is the rate over all other identities of the video (NULL without any). With
    several labelled animals on a frame the worst one counts, the lowest identity on ties.
    """
    points = pose.select("video", "identity", "frame", sum(_seen(), F.lit(0)).alias("seen"))
    counts = pose.groupBy("video").agg((F.max("identity") + 1).alias("_identities"))
    totals = points.groupBy("video", "frame").agg(F.sum("seen").alias("_all"))
    frames = frames_of(bouts.select("video", "identity", "start", "end"))
    enough = counts.filter(F.col("_identities") >= min_identities)
    joined = (
        lookup_join(frames, enough, ["video"], "inner")
        .join(points, ["video", "identity", "frame"], "left")
        .join(totals, ["video", "frame"], "left")
        .na.fill(0, ["seen", "_all"])
    )
    slots = (F.col("_identities") - 1) * expected
    rows = joined.select(
        "video", "frame", "identity",
        ((expected - F.col("seen")) / F.lit(float(expected))).alias("missing"),
        F.when(slots > 0, (slots - (F.col("_all") - F.col("seen"))) / slots).alias("others_missing"),
    )
    worst = rows.groupBy("video", "frame").agg(
        F.max_by(F.struct("missing", "others_missing"), F.struct("missing", -F.col("identity"))).alias("w")
    )
    return worst.select("video", "frame", "w.*").filter(F.col("missing") >= threshold)


def top_frames(candidates: DataFrame, num_frames: int, min_distance: int) -> DataFrame:
    """The frames with most missing keypoints, at least ``min_distance`` apart within a video.

    Taken greedily in order of ``missing`` (ties: video, frame). A chosen frame rules out at most
    2 * min_distance - 1 candidates, so the first num_frames times that many candidates always
    suffice: what one task scans is bounded by the parameters, not by the data.
    """
    reach = max(1, 2 * min_distance - 1)
    order = [F.col("missing").desc(), F.col("video"), F.col("frame")]
    head = candidates.orderBy(*order).limit(num_frames * reach)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: dict[str, set[int]] = {}
        left = num_frames
        for batch in batches:
            keep = []
            for video, frame in zip(batch["video"], batch["frame"]):
                near = taken.setdefault(video, set())
                free = left > 0 and not any(
                    f in near for f in range(frame - min_distance + 1, frame + min_distance)
                )
                keep.append(free)
                if free:
                    near.add(frame)
                    left -= 1
            yield batch[np.array(keep, dtype=bool)]

    ranked = head.coalesce(1).sortWithinPartitions(*order)
    return ranked.mapInPandas(choose, candidates.schema)
