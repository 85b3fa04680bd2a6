"""Cross-validation groups, leave-one-group-out splits and training gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.frames import running_total
from ethospark.skeleton import LABEL_THRESHOLD

STRATEGIES = ["individual", "video", "filename_pattern"]


def pattern_key(video: Column | str, pattern: str) -> Column:
    """First capture group of the match, else the whole match, else the file name."""
    if not pattern:
        raise ValueError("grouping by file name needs a pattern")
    video = F.col(video) if isinstance(video, str) else video
    groups = _count_groups(pattern)
    whole = F.regexp_extract(video, pattern, 0)
    key = whole
    if groups:
        first = F.regexp_extract(video, pattern, 1)
        key = F.when(first != "", first).otherwise(whole)
    return F.when(video.rlike(pattern), key).otherwise(video)


def _count_groups(pattern: str) -> int:
    import re

    try:
        return re.compile(pattern).groups
    except re.error as error:
        raise ValueError(f"invalid grouping pattern: {error}") from error


def group_key(strategy: str, pattern: str | None = None) -> Column:
    """The text that identifies a row's group."""
    if strategy == "individual":
        return F.concat_ws(" ", "video", F.col("identity").cast("string"))
    if strategy == "video":
        return F.col("video")
    if strategy == "filename_pattern":
        return pattern_key("video", pattern or "")
    raise ValueError(f"strategy must be one of {STRATEGIES}")


def assign_groups(animals: DataFrame, strategy: str, pattern: str | None = None) -> DataFrame:
    """(video, identity) → ``group_id``: dense ids in video order, plus the group's ``group_key``.

    Ids need one global order. Only one row per video (or pattern key) takes part in it, numbered range by
    range; the animals of a video are numbered within the video.
    """
    keyed = animals.select("video", "identity").distinct().withColumn("group_key", group_key(strategy, pattern))
    top = "group_key" if strategy == "filename_pattern" else "video"
    size = F.countDistinct("identity") if strategy == "individual" else F.lit(1)
    units = keyed.groupBy(top).agg(F.min("video").alias("_first"), size.alias("_size"))
    units = units.withColumn("_size", F.col("_size").cast("long"))
    starts = running_total(units, list(dict.fromkeys(["_first", top])), "_size", "_start").select(top, "_start")
    within = F.lit(0)
    if strategy == "individual":
        within = F.row_number().over(Window.partitionBy("video").orderBy("identity")) - 1
    return (
        keyed.withColumn("_within", within)
        .join(starts, top)
        .select("video", "identity", (F.col("_start") + F.col("_within")).cast("int").alias("group_id"), "group_key")
    )


def excluded_groups(groups: DataFrame, excluded_videos: DataFrame) -> DataFrame:
    """Groups all of whose videos are excluded from training."""
    out = excluded_videos.select("video").distinct().withColumn("_out", F.lit(True))
    return (
        groups.select("group_id", "video").distinct()
        .join(out, "video", "left")
        .groupBy("group_id")
        .agg(F.bool_and(F.coalesce("_out", F.lit(False))).alias("_all"))
        .filter("_all")
        .select("group_id")
    )


def split_validity(
    counts: DataFrame,
    excluded: DataFrame | None = None,
    threshold: int = LABEL_THRESHOLD,
    min_test_classes: int | None = None,
) -> DataFrame:
    """Per group: can it be the test side of a split?

    ``counts`` has (group_id, label, n). Training rows are those of the other, not excluded groups
    and need every class ``threshold`` times; the test side needs every class, or
    ``min_test_classes`` of them. Works on the count table alone; the class totals are one row per
    class.
    """
    if min_test_classes is not None and min_test_classes < 1:
        raise ValueError("min_test_classes must be None or >= 1")
    marked = counts.withColumn("_out", F.lit(False))
    if excluded is not None:
        out = excluded.select("group_id").distinct().withColumn("_x", F.lit(True))
        marked = counts.join(out, "group_id", "left").withColumn("_out", F.coalesce("_x", F.lit(False)))
    one = Window.partitionBy(F.lit(0))
    totals = marked.groupBy("label").agg(
        F.sum("n").alias("_all"), F.sum(F.when(F.col("_out"), 0).otherwise(F.col("n"))).alias("_usable")
    )
    totals = totals.select(
        "label", "_usable",
        F.count_if(F.col("_all") > 0).over(one).alias("_classes"),
        F.bool_and((F.col("_usable") >= threshold) | (F.col("_all") == 0)).over(one).alias("_enough"),
    )
    own = F.when(F.col("_out"), 0).otherwise(F.col("n"))
    per_group = (
        marked.join(totals, "label")
        .groupBy("group_id")
        .agg(
            F.sum("n").alias("test_rows"),
            F.count_if(F.col("n") >= threshold).alias("test_classes"),
            F.count_if(F.col("_usable") - own < threshold).alias("_short"),
            F.first("_classes").alias("_classes"),
            F.first("_enough").alias("_enough"),
        )
    )
    wanted = F.col("_classes") if min_test_classes is None else F.lit(min_test_classes)
    valid = F.col("_enough") & (F.col("_short") == 0) & (F.col("test_classes") >= wanted)
    return per_group.select("group_id", "test_rows", "test_classes", valid.alias("valid"))


def label_group_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """(group_id, label, n) of a training table."""
    return rows.groupBy("group_id", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def count_valid_splits(validity: DataFrame) -> DataFrame:
    return validity.agg(F.count_if("valid").alias("valid_splits"))


def resolve_splits(requested: float, available: int) -> int:
    """Folds to run: 0 for none, infinity for all, at most what is available."""
    if requested <= 0 or available == 0:
        return 0
    return available if math.isinf(requested) or requested > available else int(requested)


def _keyed_counts(counts: DataFrame, strategy: str, pattern: str | None, values: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    keyed = counts.withColumn("group_key", group_key(strategy, pattern))
    return keyed.groupBy("group_key", *more).agg(*[F.sum(v).alias(v) for v in values])


def binary_groups_ready(
    counts: DataFrame, strategy: str = "individual", pattern: str | None = None,
    threshold: int = LABEL_THRESHOLD,
) -> DataFrame:
    """Groups with enough frames of both classes (``ready_groups``), from the label counts."""
    sums = _keyed_counts(counts, strategy, pattern, ["fragmented_frames_behavior", "fragmented_frames_not"])
    both = (F.col("fragmented_frames_behavior") >= threshold) & (F.col("fragmented_frames_not") >= threshold)
    return sums.agg(F.count_if(both).alias("ready_groups"))


def binary_ready(ready_groups: int, min_groups: int) -> bool:
    return 1 < ready_groups >= min_groups


def multiclass_groups_ready(
    counts: DataFrame, behaviors: Sequence[str], strategy: str = "individual",
    pattern: str | None = None, threshold: int = LABEL_THRESHOLD,
) -> DataFrame:
    """Groups that could be tested: two classes in the group, every class in the others."""
    relevant = counts.filter(F.col("behavior").isin(*behaviors))
    sums = _keyed_counts(relevant, strategy, pattern, ["fragmented_frames_behavior"], ["behavior"])
    frames = F.col("fragmented_frames_behavior")
    totals = sums.groupBy("behavior").agg(F.sum(frames).alias("_total"))
    one = Window.partitionBy(F.lit(0))  # totals hold one row per behaviour
    totals = totals.select(
        "behavior", "_total",
        ((F.count_if(F.col("_total") >= threshold).over(one)) == len(behaviors)).alias("_enough"),
    )
    per_group = (
        sums.join(totals, "behavior")
        .groupBy("group_key")
        .agg(
            F.count_if(frames >= threshold).alias("_test"),
            F.count_if(F.col("_total") - frames < threshold).alias("_short"),
            F.first("_enough").alias("_enough"),
        )
    )
    ok = F.col("_enough") & (F.col("_test") >= 2) & (F.col("_short") == 0)
    return per_group.agg(F.count_if(ok).alias("ready_groups"))


def multiclass_ready(ready_groups: int, behaviors: Sequence[str], min_groups: int) -> bool:
    return len(behaviors) >= 2 and ready_groups >= max(1, min_groups)
