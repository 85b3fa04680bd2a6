"""Feature matrices: column selection, labelled rows, cleaning, augmentation, balancing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ethospark.operators.frames import lookup_join, number_frames, seeded_draw
from ethospark.operators.labels import BEHAVIOR, NONE, multiclass_labels
from ethospark.operators.windows import LINEAR_OPS, quoted
from ethospark.skeleton import TRAINING_SEED

FRAME = ["video", "identity", "frame"]

# Module names behind each feature setting.
SOCIAL_MODULES = [
    "closest_distances", "closest_fov_angles", "closest_fov_distances",
    "social_pairwise_distances", "social_pairwise_fov_distances",
]
SEGMENTATION_MODULES = ["moments", "hu_moments", "shape_descriptor"]
OBJECT_MODULES = {
    "corners": ["corner_distances", "corner_bearings"],
    "lixit": ["lixit_distances", "lixit_bearings", "mouse_lixit_angle"],
    "food_hopper": ["food_hopper"],
}
CIRCULAR_MODULES = [
    "angles", "point_velocity_dirs", "centroid_velocity_dir", "closest_fov_angles",
    "corner_bearings", "lixit_bearings",
]
SPECTRAL_PREFIXES = ("fft_band", "psd_")


def is_circular(feature: str) -> bool:
    """Whether a per-frame column is summarised with circular statistics."""
    module = feature.split(" ", 1)[0]
    return module in CIRCULAR_MODULES and not feature.endswith((" sine", " cosine"))


# --- columns --------------------------------------------------------------------------------


def selected_columns(
    columns: Sequence[str],
    social: bool = True,
    segmentation: bool = True,
    static_objects: Mapping[str, bool] | None = None,
    window: bool = True,
    fft: bool = True,
) -> list[str]:
    """Feature columns left by the settings; keys stay.

    ``window`` and ``fft`` concern window columns (``module op feature``): the plain statistics
    and the spectral ones.
    """
    dropped: set[str] = set()
    if not social:
        dropped.update(SOCIAL_MODULES)
    if not segmentation:
        dropped.update(SEGMENTATION_MODULES)
    for name, enabled in (static_objects or {}).items():
        if not enabled:
            dropped.update(OBJECT_MODULES.get(name, []))

    def keep(column: str) -> bool:
        parts = column.split(" ", 2)
        if len(parts) == 1:
            return True
        if parts[0] in dropped:
            return False
        op = parts[1] if len(parts) == 3 else ""
        if op in LINEAR_OPS and not window:
            return False
        return not (op.startswith(SPECTRAL_PREFIXES) and not fft)

    return [c for c in columns if keep(c)]


def available_modules(version: int, objects: Sequence[str], lixit_points: int = 0) -> list[str]:
    """Optional feature groups a pose version and its static objects allow."""
    out = []
    if version >= 3:
        out += SOCIAL_MODULES
    if version >= 5:
        for name, modules in OBJECT_MODULES.items():
            if name in objects:
                out += [m for m in modules if m != "mouse_lixit_angle" or lixit_points == 3]
    if version >= 6:
        out += SEGMENTATION_MODULES
    return out


def model_columns(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns a model was trained on, in its order; a missing one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*map(quoted, [*keep, *names]))


def stack_common(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables over the columns all of them have."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*map(quoted, shared)) for t in tables])


def stack_videos(features: DataFrame, columns: Sequence[str], by: str = "video") -> DataFrame:
    """Keep the feature columns every video has values for (one grouped pass, one small row)."""
    known = features.groupBy(by).agg(*[F.count(quoted(c)).alias(c) for c in columns])
    every = known.agg(*[F.min(quoted(c)).alias(c) for c in columns]).first()  # a single row
    kept = [c for c in columns if every[c]]
    others = [c for c in features.columns if c not in columns]
    return features.select(*map(quoted, [*others, *kept]))


# --- rows ---------------------------------------------------------------------------------


def labelled_rows(features: DataFrame, labels: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of labelled frames on which the animal is present, with ``label``."""
    marked = labels.filter(F.col("label") != NONE).select(*FRAME, "label")
    return features.join(marked, FRAME).join(present.select(*FRAME), FRAME, "left_semi")


def classification_input(per_frame: DataFrame, window: DataFrame, present: DataFrame) -> DataFrame:
    """Per-frame and window features side by side, with ``valid``: animal present on the frame."""
    here = present.select(*FRAME, F.lit(True).alias("_here"))
    return (
        per_frame.join(window, FRAME)
        .join(here, FRAME, "left")
        .withColumn("valid", F.coalesce("_here", F.lit(False)))
        .drop("_here")
    )


def binary_training_rows(
    features: DataFrame, labels: DataFrame, present: DataFrame, behavior: str
) -> DataFrame:
    """Training rows of one behaviour: both classes, frames with the animal only."""
    return labelled_rows(features, labels.filter(F.col("behavior") == behavior), present)


def multiclass_training_rows(
    features: DataFrame, labels: DataFrame, present: DataFrame, behaviors: Sequence[str]
) -> DataFrame:
    """Rows that show a behaviour (or the background track), with the class index as ``label``."""
    if not behaviors:
        raise ValueError("behaviors must not be empty")
    shown = labels.filter(F.col("label") == BEHAVIOR).join(present.select(*FRAME), FRAME, "left_semi")
    classes = multiclass_labels(shown, behaviors).withColumnRenamed("cls", "label")
    return features.join(classes, FRAME)


def included_rows(rows: DataFrame, excluded_groups: DataFrame, group: str = "group_id") -> DataFrame:
    """Rows whose group is not held out of the final training."""
    return rows.join(excluded_groups.select(group).distinct(), group, "left_anti")


# --- values ---------------------------------------------------------------------------------


def clean(features: DataFrame, columns: Sequence[str], learner: str) -> DataFrame:
    """Boosted trees: infinities become NULL. Random forest: infinities and gaps become 0."""
    forest = learner == "random_forest"
    odd = "isnan(double(`{0}`)) OR abs(double(`{0}`)) = double('Infinity')"
    if forest:
        text = f"CASE WHEN `{{0}}` IS NULL OR {odd} THEN 0D ELSE double(`{{0}}`) END AS `{{0}}`"
    else:
        text = f"CASE WHEN NOT ({odd}) THEN double(`{{0}}`) END AS `{{0}}`"
    wanted = set(columns)
    return features.selectExpr(*[text.format(c) if c in wanted else f"`{c}`" for c in features.columns])


def mirrored_name(name: str) -> str:
    """Lower-cased name with left and right exchanged."""
    swap = {"left": "right", "right": "left"}
    return re.sub("left|right", lambda m: swap[m.group()], name.lower())


def augment_symmetric(features: DataFrame, columns: Sequence[str], mark: str | None = None) -> DataFrame:
    """Rows plus their mirror images: left/right column pairs exchange values. A column ``mark`` tells images.

    Names pair up without regard to case; a column whose partner does not exist keeps its values.
    Both copies come out of one pass over the input.
    """
    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(c.lower(), c)
    partner = {c: by_name.get(mirrored_name(c), c) for c in columns}
    others = [c for c in features.columns if c not in set(columns)]
    twice = features.withColumn("_mirror", F.explode(F.array(F.lit(False), F.lit(True))))
    return twice.selectExpr(
        *[f"`{c}`" for c in others],
        *[f"IF(_mirror, `{partner[c]}`, `{c}`) AS `{c}`" for c in columns],
        *([f"_mirror AS `{mark}`"] if mark else []),
    )


def balance(rows: DataFrame, key: Sequence[str], label: str = "label", seed: int = TRAINING_SEED) -> DataFrame:
    """Down-sample every class to the size of the rarest, without replacement.

    Rows are ranked within their class by a seeded digest of their key. The rank is counted per digest
    range first (65,536 of them), so a class that holds most rows is spread over many tasks.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # one row per class from here on
    limits = counts.select(label, F.min("_n").over(Window.partitionBy(F.lit(0))).alias("_limit"))
    drawn = rows.withColumn("_draw", seeded_draw(seed, key))
    ranked = number_frames(drawn, [label], ["_draw", *key], "left(_draw, 4)", "_rank")
    kept = lookup_join(ranked, limits, [label], "inner").filter(F.col("_rank") < F.col("_limit"))
    return kept.drop("_draw", "_rank", "_limit")
