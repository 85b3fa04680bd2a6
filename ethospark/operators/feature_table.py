"""The per-frame and window feature tables of a set of videos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ethospark.operators import base_features, landmark_features, segmentation_features, social_features
from ethospark.operators.base_features import FrameRate
from ethospark.operators.matrix import (
    SEGMENTATION_MODULES,
    SOCIAL_MODULES,
    available_modules,
    is_circular,
    selected_columns,
)
from ethospark.operators.pose import ANIMAL, video_lengths
from ethospark.operators.window_matrix import window_matrix
from ethospark.skeleton import DEFAULT_FPS

FRAME = [*ANIMAL, "frame"]


def per_frame_table(
    pose: DataFrame,
    objects: DataFrame | None = None,
    contours: DataFrame | None = None,
    scales: DataFrame | None = None,
    version: int = 8,
    object_names: Sequence[str] = (),
    lixit_points: int = 0,
    fps: FrameRate = DEFAULT_FPS,
    modules: Sequence[str] | None = None,
    **settings,
) -> DataFrame:
    """Keys, frame, ``present`` and every per-frame feature the inputs and settings allow.

    ``modules`` narrows the table to the named modules. Where ``scales`` has a column ``fps``, every video
    has its own frame rate, and the table keeps it for the window features.

    ``version``, ``object_names`` and ``lixit_points`` describe what all videos have (see
    ``project.capability``); modules that need more are not planned at all.
    """
    rows = base_features.prepare(pose, scales, version)
    own_rates = scales is not None and "fps" in scales.columns
    fps = "fps" if own_rates else fps
    columns = base_features.base_features(fps, modules)
    allowed = set(available_modules(version, object_names, lixit_points))
    if modules is not None:
        allowed &= set(modules)
    if allowed & {"corner_distances", "corner_bearings"}:
        rows = landmark_features.with_corners(rows, objects)
        columns |= landmark_features.corner_distances() | landmark_features.corner_bearings()
    if allowed & {"lixit_distances", "lixit_bearings", "mouse_lixit_angle"}:
        rows = landmark_features.with_lixit(rows, objects)
        columns |= landmark_features.lixit_distances() | landmark_features.lixit_bearings()
        if "mouse_lixit_angle" in allowed:
            columns |= landmark_features.mouse_lixit_angle()
    if "food_hopper" in allowed:
        rows = landmark_features.with_hopper(rows, objects)
        columns |= landmark_features.food_hopper()
    if modules is not None:
        columns = {n: c for n, c in columns.items() if n.split(" ", 1)[0] in modules}
    keep = set(selected_columns(list(columns), **settings))
    own = {n: c for n, c in columns.items() if n in keep}
    with_social = bool(allowed & set(SOCIAL_MODULES)) and settings.get("social", True)
    # the social step regroups rows by frame, so everything else is computed before it and
    # carried along under its final name
    done = base_features.with_features(rows, own)
    # what is not needed any more must not travel with the frames
    done = done.drop(*[c for c in done.columns if c.startswith("g_")], "next_bearing", "bearing")
    names = list(own)
    if with_social:
        done = social_features.nearest_animals(done)
        social = {n: c for n, c in social_features.social_features().items() if n.split(" ", 1)[0] in allowed}
        done = base_features.with_features(done, social)
        names += list(social)
    table = done.selectExpr(*FRAME, "present", *(["fps"] if own_rates else []), *[f"`{n}`" for n in names])
    if contours is not None and allowed & set(SEGMENTATION_MODULES) and settings.get("segmentation", True):
        shapes = segmentation_features.with_moments(segmentation_features.shape_rows(contours, scales))
        shapes = segmentation_features.with_outline(shapes)
        shapes = segmentation_features.with_centroid_speed(shapes, video_lengths(pose), fps)
        found = (
            segmentation_features.moments()
            | segmentation_features.hu_moments()
            | segmentation_features.shape_descriptors()
        )
        found = {n: c for n, c in found.items() if n.split(" ", 1)[0] in allowed}
        table = table.join(base_features.select_features(shapes, found), FRAME, "left")
    return table


def feature_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in (*FRAME, "present", "fps")]


def window_table(
    per_frame: DataFrame, k: int, fps: FrameRate | None = None, window: bool = True, fft: bool = True,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Keys, frame and every window feature of size ``k``; point masks have none.

    ``fps`` is the table's own column, if it has one and no other rate is given.
    """
    if fps is None:
        fps = "fps" if "fps" in per_frame.columns else DEFAULT_FPS
    names = [c for c in feature_columns(per_frame) if not c.startswith("point_mask ")]
    circular = {c: 0.0 if c.startswith("angles ") else -180.0 for c in names if is_circular(c)}
    linear = [c for c in names if c not in circular]
    options = {} if window else {"ops": ()}
    options |= {} if fft else {"spectral_ops": ()}
    return window_matrix(
        per_frame, ANIMAL, k, linear, circular if window else {}, "present", fps=fps, carry=carry, **options
    )


def training_matrix(
    per_frame: DataFrame, k: int, fps: FrameRate | None = None, window: bool = True, fft: bool = True
) -> DataFrame:
    """Per-frame and window features side by side, for frames with the animal present.

    Both come out of the same pass over the per-frame table, without a join.
    """
    both = window_table(per_frame, k, fps, window, fft, ["present", *feature_columns(per_frame)])
    return both.filter("present")
