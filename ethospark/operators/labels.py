"""Behaviour labels: blocks and frames, editing, merging, counting, annotations.

``label_block``: track columns, ``start``, ``end`` (inclusive), ``present``. ``label_frame``: track
columns, ``frame``, ``label`` (1 behaviour, 0 not); an unlabelled frame has no row. A track is
(video, identity, behavior).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethospark.operators.frames import frames_of, lookup_join, overlap_join, runs, spine

TRACK = ["video", "identity", "behavior"]
NONE, NOT_BEHAVIOR, BEHAVIOR, MIX, PAD = -1, 0, 1, 2, 3
NO_BEHAVIOR_TRACK = "None"  # reserved track: explicit background in multi-class labelling
LEAST_PARTS = 200  # parts that painted frames are dealt to, more if the session shuffles to more


# --- blocks and frames -----------------------------------------------------------------


def blocks_to_frames(
    blocks: DataFrame, keys: Sequence[str] = TRACK, order: str | None = None
) -> DataFrame:
    """Paint blocks onto frames; with ``order``, later blocks overwrite earlier ones."""
    painted = frames_of(
        blocks.select(
            *keys, "start", "end", F.col("present").cast("int").alias("label"),
            *([order] if order else []),
        )
    )
    if order is None:
        return painted.select(*keys, "frame", "label")
    return _latest(painted, [*keys, "frame"], "label", F.col(order))


def _latest(painted: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """``value`` of the last row in ``order`` per frame (``keys``).

    Hardly any frame is painted twice, so a count in advance would hold all frames in the task that paints them; and
    painted frames pack so well that shuffled parts of the usual size are some 100 times larger in memory. So
    rows are dealt out first, to a number of parts that Spark does not join again.
    """
    parts = max(int(painted.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_PARTS)
    dealt = painted.repartition(parts, *keys)
    return dealt.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def frames_to_blocks(frames: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Runs of equal label as blocks."""
    labelled = frames.filter(F.col("label") != NONE)
    return runs(labelled, keys, ["label"]).select(
        *keys, "start", "end", (F.col("label") == BEHAVIOR).alias("present")
    )


def edit(
    frames: DataFrame,
    edits: DataFrame,
    keys: Sequence[str] = TRACK,
    present: DataFrame | None = None,
) -> DataFrame:
    """Apply range edits in ``seq`` order: ``label`` 1/0 sets, -1 clears.

    With ``present`` (video, identity, frame), setting touches only frames with the animal;
    clearing always applies.
    """
    painted = frames_of(edits.select(*keys, "start", "end", "label", "seq"))
    if present is not None:
        here = painted.join(
            present.select("video", "identity", "frame"), ["video", "identity", "frame"], "left_semi"
        )
        painted = here.unionByName(painted.filter(F.col("label") == NONE))
    base = frames.select(*keys, "frame", "label", F.lit(None).cast("bigint").alias("seq"))
    layers = base.unionByName(painted.withColumn("seq", F.col("seq").cast("bigint")))
    latest = _latest(layers, [*keys, "frame"], "label", F.coalesce("seq", F.lit(-1)))
    return latest.filter(F.col("label") != NONE)


def fragmented(frames: DataFrame, present: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Blocks of the labels on frames where the animal is present."""
    visible = frames.join(
        present.select("video", "identity", "frame"), ["video", "identity", "frame"], "left_semi"
    )
    return frames_to_blocks(visible, keys)


def slice_blocks(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks cut to frames start..end, numbered from the slice start."""
    return blocks.filter((F.col("end") >= start) & (F.col("start") <= end)).withColumns({
        "start": F.greatest(F.col("start"), F.lit(start)) - start,
        "end": F.least(F.col("end"), F.lit(end)) - start,
    })


# --- counts -----------------------------------------------------------------------------


def _counts(prefix: str) -> list[Column]:
    length = F.col("end") - F.col("start") + 1
    yes, no = F.col("present"), ~F.col("present")
    return [
        F.coalesce(F.sum(F.when(yes, length)), F.lit(0)).cast("bigint").alias(f"{prefix}_frames_behavior"),
        F.coalesce(F.sum(F.when(no, length)), F.lit(0)).cast("bigint").alias(f"{prefix}_frames_not"),
        F.count_if(yes).alias(f"{prefix}_bouts_behavior"),
        F.count_if(no).alias(f"{prefix}_bouts_not"),
    ]


COUNT_COLUMNS = ["frames_behavior", "frames_not", "bouts_behavior", "bouts_not"]


def bout_counts(blocks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Number of behaviour and not-behaviour bouts per track."""
    return blocks.groupBy(*keys).agg(
        F.count_if(F.col("present")).alias("bouts_behavior"),
        F.count_if(~F.col("present")).alias("bouts_not"),
    )


def label_counts(unfragmented: DataFrame, frag: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Frame and bout counts of both views per track.

    A video that has no unfragmented view at all (older files) takes the fragmented counts.
    """
    whole = unfragmented.groupBy(*keys).agg(*_counts("unfragmented"))
    parts = frag.groupBy(*keys).agg(*_counts("fragmented"))
    new_format = unfragmented.select("video").distinct().withColumn("_new", F.lit(True))
    both = whole.join(parts, list(keys), "full_outer").join(new_format, "video", "left")
    zero = F.lit(0).cast("bigint")
    out = {f"fragmented_{c}": F.coalesce(f"fragmented_{c}", zero) for c in COUNT_COLUMNS}
    out |= {
        f"unfragmented_{c}": F.when(F.col("_new"), F.coalesce(f"unfragmented_{c}", zero)).otherwise(
            F.coalesce(f"fragmented_{c}", zero)
        )
        for c in COUNT_COLUMNS
    }
    return both.withColumns(out).select(*keys, *sorted(out))


def included_counts(counts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Counts of the videos that are not excluded from training."""
    return counts.join(excluded.select("video").distinct(), "video", "left_anti")


def included_bout_totals(counts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Bout totals per behaviour over the included videos."""
    return included_counts(counts, excluded).groupBy("behavior").agg(
        F.sum("unfragmented_bouts_behavior").alias("bouts_behavior"),
        F.sum("unfragmented_bouts_not").alias("bouts_not"),
    )


# --- down-sampling ------------------------------------------------------------------------


def downsample(
    frames: DataFrame, lengths: DataFrame, size: int, keys: Sequence[str] = TRACK
) -> DataFrame:
    """Exactly ``size`` bins per track; ``lengths`` has the keys and ``num_frames``.

    Bins hold ceil(num_frames / size) frames; the missing frames of the last bins are padding.
    """
    bin_size = F.ceil(F.col("num_frames") / size)
    tracks = lengths.select(*keys, bin_size.alias("_bin_size"), "num_frames")
    tallies = (
        lookup_join(frames.filter(F.col("label") != NONE), tracks.drop("num_frames"), keys, "inner")
        .groupBy(*keys, F.floor(F.col("frame") / F.col("_bin_size")).cast("int").alias("bin"))
        .agg(
            F.count_if(F.col("label") == BEHAVIOR).alias("_yes"),
            F.count_if(F.col("label") == NOT_BEHAVIOR).alias("_no"),
        )
    )
    bins = tracks.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    full = bins.join(tallies, [*keys, "bin"], "left").na.fill(0, ["_yes", "_no"])
    real = F.least(
        F.greatest(F.col("num_frames") - F.col("bin") * F.col("_bin_size"), F.lit(0)), F.col("_bin_size")
    )
    value = (
        F.when((F.col("_yes") > 0) & (F.col("_no") > 0), MIX)
        .when(F.col("_yes") > 0, BEHAVIOR)
        .when(F.col("_no") > 0, NOT_BEHAVIOR)
        .when(real == F.col("_bin_size"), NONE)
        .otherwise(PAD)
    )
    return full.select(*keys, "bin", value.cast("int").alias("label"))


def class_shares(
    class_runs: DataFrame, lengths: DataFrame, size: int, keys: Sequence[str]
) -> DataFrame:
    """Share of each class in ``size`` equal real-valued bins per sequence.

    ``class_runs`` are runs (start, end, ``cls``) that cover every frame, class 0 being
    background. Background counts only in bins without any labelled frame. Working on runs, a
    run contributes one row per bin it reaches, not one per frame.
    """
    width = F.col("num_frames") / F.lit(float(size))
    reach = lookup_join(class_runs, lengths, keys, "inner").withColumn("_width", width)
    begin, stop = F.col("start").cast("double"), F.col("end") + F.lit(1.0)
    first = F.floor(begin / F.col("_width")).cast("int")
    last = F.least(F.ceil(stop / F.col("_width")).cast("int"), F.lit(size)) - 1
    spread = reach.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
    overlap = F.least(stop, (F.col("bin") + 1) * F.col("_width")) - F.greatest(
        begin, F.col("bin") * F.col("_width")
    )
    weights = (
        spread.withColumn("_overlap", overlap)
        .filter(F.col("_overlap") > 1e-9)
        .groupBy(*keys, "bin", "cls")
        .agg(F.sum("_overlap").alias("_weight"), F.first("_width").alias("_width"))
    )
    # at most one row per class is left in a bin, so this second grouping is tiny
    labelled = weights.groupBy(*keys, "bin").agg(
        F.sum(F.when(F.col("cls") > 0, F.col("_weight"))).alias("_labelled")
    )
    joined = weights.join(labelled, [*keys, "bin"])
    shown = F.col("_labelled").isNull() | (F.col("cls") > 0)
    return joined.filter(shown).select(
        *keys, "bin", "cls",
        (F.col("_weight") / F.coalesce("_labelled", "_width")).alias("share"),
    )


# --- merging ------------------------------------------------------------------------------

STRATEGIES = ["BEHAVIOR_WINS", "NOT_BEHAVIOR_WINS", "DESTINATION_WINS"]


def merge(
    destination: DataFrame, source: DataFrame, strategy: str, keys: Sequence[str] = TRACK,
    lengths: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Merge two labellings of the same tracks, frame by frame.

    Frames only one side labels are taken over; where both do, the strategy decides. ``lengths`` of
    both sides (keys or some of them, ``num_frames``) are compared: tracks of different lengths raise.
    """
    mine, theirs = F.col("_mine"), F.col("_theirs")
    if strategy == "BEHAVIOR_WINS":
        both = F.greatest(mine, theirs)
    elif strategy == "NOT_BEHAVIOR_WINS":
        both = F.least(mine, theirs)
    elif strategy == "DESTINATION_WINS":
        both = F.coalesce(mine, theirs)
    else:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    # greatest/least skip NULL, so the one-sided case needs no branch
    merged = destination.withColumnRenamed("label", "_mine").join(
        source.withColumnRenamed("label", "_theirs"), [*keys, "frame"], "full_outer"
    ).select(*keys, "frame", both.alias("label"))
    if lengths is None:
        return merged
    own, other = lengths
    shared = [k for k in keys if k in own.columns]
    differing = own.join(other.withColumnRenamed("num_frames", "_other"), shared).filter("num_frames <> _other")
    text = F.concat_ws(" ", F.lit("cannot merge labels of different lengths:"), *shared)
    odd = {c: F.lit(None).cast(merged.schema[c].dataType) for c in merged.columns if c != "frame"}
    failing = F.raise_error(text).cast(merged.schema["frame"].dataType)
    return merged.unionByName(differing.select(*[c.alias(n) for n, c in odd.items()], failing.alias("frame")))


def merge_projects(
    destination: dict[str, DataFrame], source: dict[str, DataFrame], strategy: str
) -> dict[str, DataFrame]:
    """Merge a source project into a destination project.

    Projects are dicts of ``videos`` (video, pose_hash, num_frames), ``behaviors`` (behavior, …)
    and ``labels`` (label frames). Videos and behaviours only the source has are added; labels
    of a shared video are merged unless pose hash or length differ: those videos are listed
    in ``skipped`` (video, reason).
    """
    videos = destination["videos"].unionByName(
        source["videos"].join(destination["videos"].select("video"), "video", "left_anti")
    )
    behaviors = destination["behaviors"].unionByName(
        source["behaviors"].join(destination["behaviors"].select("behavior"), "behavior", "left_anti")
    )
    other = destination["videos"].select(
        "video", F.col("pose_hash").alias("_hash"), F.col("num_frames").alias("_frames")
    )
    mismatch = source["videos"].join(other, "video").filter(
        ~F.col("pose_hash").eqNullSafe(F.col("_hash"))
        | ~F.col("num_frames").eqNullSafe(F.col("_frames"))
    )
    same_pose = F.col("pose_hash").eqNullSafe(F.col("_hash"))
    reason = F.when(same_pose, "length differs").otherwise("pose differs")
    usable = source["labels"].join(mismatch.select("video"), "video", "left_anti")
    return {
        "videos": videos,
        "behaviors": behaviors,
        "labels": merge(destination["labels"], usable, strategy),
        "skipped": mismatch.select("video", reason.alias("reason")),
    }


# --- several behaviours per animal ---------------------------------------------------------


def _class_index(behaviors: Sequence[str], first: int) -> Column:
    names = list(behaviors)
    if NO_BEHAVIOR_TRACK in names or len(names) != len(set(names)):
        raise ValueError("behaviour names must be unique and must not include the background track")
    index = F.when(F.col("behavior") == NO_BEHAVIOR_TRACK, first)
    for offset, name in enumerate(names, 1):
        index = index.when(F.col("behavior") == name, first + offset)
    return index


def multiclass_labels(frames: DataFrame, behaviors: Sequence[str]) -> DataFrame:
    """One class per labelled frame: 0 background track, i for the i-th behaviour (1-based).

    A frame that shows two behaviours raises.
    """
    index = _class_index(behaviors, 0)
    shown = frames.filter(F.col("label") == BEHAVIOR).withColumn("_cls", index)
    per_frame = (
        shown.filter(F.col("_cls").isNotNull())
        .groupBy("video", "identity", "frame")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_cls").alias("_cls"))
    )
    conflict = F.raise_error(
        F.concat_ws(" ", F.lit("conflicting labels at"), "video", "identity", "frame")
    ).cast("int")
    return per_frame.select(
        "video", "identity", "frame", F.when(F.col("_n") > 1, conflict).otherwise(F.col("_cls")).alias("cls")
    )


def display_track(
    frames: DataFrame, lengths: DataFrame, behaviors: Sequence[str]
) -> DataFrame:
    """Dense class index per frame: 0 unlabelled, 1 background track, i + 2 for behaviour i."""
    shown = (
        frames.filter(F.col("label") == BEHAVIOR)
        .withColumn("_cls", _class_index(behaviors, 1))
        .groupBy("video", "identity", "frame")
        .agg(F.max("_cls").alias("_cls"))
    )
    return (
        spine(lengths, ["video", "identity"])
        .join(shown, ["video", "identity", "frame"], "left")
        .select("video", "identity", "frame", F.coalesce("_cls", F.lit(0)).alias("cls"))
    )


def overlapping_videos(frames: DataFrame) -> DataFrame:
    """Videos in which one animal shows two behaviours on the same frame."""
    return (
        frames.filter(F.col("label") == BEHAVIOR)
        .groupBy("video", "identity", "frame")
        .count()
        .filter(F.col("count") > 1)
        .select("video")
        .distinct()
    )


def exclusive_edits(frames: DataFrame, edits: DataFrame, multiclass: bool = True) -> DataFrame:
    """Apply (start, end, behavior, positive, seq) edits.

    Multi-class: an edit replaces whatever the animal had on its frames, in any track, and a
    negative edit writes the background track. Binary: an edit sets its own track only.
    """
    if not multiclass:
        own = edits.withColumn("label", F.col("positive").cast("int"))
        return edit(frames, own)
    target = F.when(F.col("positive"), F.col("behavior")).otherwise(F.lit(NO_BEHAVIOR_TRACK))
    painted = frames_of(
        edits.select("video", "identity", "start", "end", target.alias("behavior"), "seq")
    )
    latest = _latest(painted, ["video", "identity", "frame"], "behavior", F.col("seq"))
    untouched = frames.join(latest.select("video", "identity", "frame"), ["video", "identity", "frame"], "left_anti")
    return untouched.select(*TRACK, "frame", "label").unionByName(
        latest.select(*TRACK, "frame", F.lit(BEHAVIOR).alias("label"))
    )


# --- project-level operations ---------------------------------------------------------------


def labeled_identities(blocks: DataFrame, behaviors: Sequence[str]) -> DataFrame:
    """Animals with any label (either view) for one of the behaviours."""
    return blocks.filter(F.col("behavior").isin(*behaviors)).select("video", "identity").distinct()


def rename_behavior(blocks: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a behaviour; a name that is already in use is an error."""
    if new == NO_BEHAVIOR_TRACK:
        raise ValueError(f"{new!r} is reserved")
    if not blocks.filter(F.col("behavior") == new).isEmpty():
        raise ValueError(f"behaviour {new!r} already exists")
    return blocks.withColumn(
        "behavior", F.when(F.col("behavior") == old, new).otherwise(F.col("behavior"))
    )


def videos_to_prune(videos: DataFrame, blocks: DataFrame, behavior: str | None = None) -> DataFrame:
    """Videos without any label (of one behaviour, or at all)."""
    labelled = blocks if behavior is None else blocks.filter(F.col("behavior") == behavior)
    return videos.join(labelled.select("video").distinct(), "video", "left_anti")


def archive_behavior(blocks: DataFrame, behavior: str) -> tuple[DataFrame, DataFrame]:
    """Split into (live, archived) blocks."""
    mine = F.col("behavior") == behavior
    return blocks.filter(~mine), blocks.filter(mine)


def bout_at(blocks: DataFrame, points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """The block each (keys, ``frame``) point lies in; unlabelled points give no row."""
    return overlap_join(points, blocks, keys, ("frame", "frame"), ("start", "end"))


# --- timeline annotations --------------------------------------------------------------------


def _same_annotation(a: str, b: str) -> Column:
    return (
        (F.col(f"{a}.video") == F.col(f"{b}.video"))
        & (F.col(f"{a}.start") == F.col(f"{b}.start"))
        & (F.col(f"{a}.end") == F.col(f"{b}.end"))
        & (F.lower(f"{a}.tag") == F.lower(f"{b}.tag"))
        & F.col(f"{a}.identity").eqNullSafe(F.col(f"{b}.identity"))
    )


def find_annotations(annotations: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Annotations whose (video, start, end, tag, identity) is in ``wanted``.

    Tags compare without case and a NULL identity matches only NULL. ``how="left_anti"`` deletes
    the matches instead.
    """
    return annotations.alias("a").join(wanted.alias("w"), _same_annotation("a", "w"), how)


def annotations_in(annotations: DataFrame, ranges: DataFrame) -> DataFrame:
    """Annotations overlapping each (video, ``lo``, ``hi``) range."""
    return overlap_join(ranges, annotations, ["video"], ("lo", "hi"), ("start", "end"))
