"""Per-frame features of one animal: distances, angles, speeds, directions.

Input is a *prepared* pose (see ``prepare``). Every module is a dict of SQL expressions named
``module feature``, so one projection computes any choice of modules in a single stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ethospark.functions.angles import (
    corner_angle,
    direction,
    distance,
    length,
    sine_cosine,
    wrap,
)
from ethospark.operators.frames import with_neighbours
from ethospark.operators.pose import (
    ANIMAL,
    POINTS,
    scaled,
    video_facts,
    with_bearing,
    with_centroid,
    with_presence,
)
from ethospark.skeleton import ANGLES, DEFAULT_FPS, INDEX, KEYPOINTS

FrameRate = float | str  # one number, or the name of a column
Features = dict[str, str]


def rate(fps: FrameRate) -> str:
    """Frames per second as SQL text: one number for all videos, or the column that has each video's."""
    return f"`{fps}`" if isinstance(fps, str) else f"{float(fps)}D"


def prepare(
    pose: DataFrame, scales: DataFrame | None = None, version: int = 4
) -> DataFrame:
    """Add what the feature modules share: presence, bearing, scale, hull centroid, neighbours.

    ``g_<name>`` is the gradient of a coordinate or of the centroid and ``next_bearing`` the bearing
    one frame later. One windowed pass serves all modules. Facts of the video in ``scales`` come along.
    """
    rows = with_centroid(with_bearing(with_presence(scaled(pose, scales), version), video_facts(pose)))
    moving = [f"{a}_{k}" for a in "xy" for k in POINTS] + ["cx", "cy"]
    around = with_neighbours(rows, ANIMAL, [*moving, "bearing"])
    gradients = [f"{gradient(name)} AS g_{name}" for name in moving]
    return around.selectExpr("*", *gradients, "after.bearing AS next_bearing").drop("before", "after")


def gradient(name: str) -> str:
    """Change per frame: central inside the video, one-sided at its first and last frame."""
    return (
        f"(CASE WHEN num_frames = 1 THEN NULL WHEN frame = 0 THEN after.{name} - {name} "
        f"WHEN frame = num_frames - 1 THEN {name} - before.{name} "
        f"ELSE (after.{name} - before.{name}) / 2 END)"
    )


def point_mask() -> Features:
    return {f"point_mask point_mask {n}": f"double(ok_{k})" for k, n in enumerate(KEYPOINTS)}


def pairwise_distances() -> Features:
    return {
        f"pairwise_distances {KEYPOINTS[i]}-{KEYPOINTS[j]}":
        f"{distance(f'x_{i}', f'y_{i}', f'x_{j}', f'y_{j}')} * scale"
        for i in POINTS
        for j in POINTS
        if i < j
    }


def angles() -> Features:
    """Turn at the middle point of each named triple, in [0, 360), with sine and cosine."""
    out: Features = {}
    for names in ANGLES:
        points = [f"{a}_{INDEX[n]}" for n in names for a in "xy"]
        out |= sine_cosine(f"angles angle {'-'.join(names)}", wrap(corner_angle(*points), 0))
    return out


def angular_velocity(fps: FrameRate = DEFAULT_FPS) -> Features:
    """Turn of the bearing to the next frame per second, the short way round."""
    diff = f"({wrap('next_bearing', 0)} - {wrap('bearing', 0)})"
    short = f"CASE WHEN {diff} > 180 THEN {diff} - 360 WHEN {diff} < -180 THEN {diff} + 360 ELSE {diff} END"
    return {"angular_velocity angular_velocity": f"({short}) * {rate(fps)}"}


def point_speeds(fps: FrameRate = DEFAULT_FPS) -> Features:
    return {
        f"point_speeds {n} speed": f"{length(f'g_x_{k}', f'g_y_{k}')} * {rate(fps)} * scale"
        for k, n in enumerate(KEYPOINTS)
    }


def point_velocity_dirs() -> Features:
    """Direction of motion relative to the bearing, turned by half a turn, in [-180, 180)."""
    out: Features = {}
    for k, n in enumerate(KEYPOINTS):
        motion = direction(f"g_x_{k}", f"g_y_{k}")
        relative = f"({wrap(f'{motion} - bearing', 0)} - 180)"
        out |= sine_cosine(f"point_velocity_dirs {n} velocity direction", relative)
    return out


def centroid_velocity_dir() -> Features:
    motion = direction("g_cx", "g_cy")
    return sine_cosine("centroid_velocity_dir centroid_velocity_dir", wrap(f"{motion} - bearing"))


def centroid_velocity_mag(fps: FrameRate = DEFAULT_FPS) -> Features:
    speed = length("g_cx", "g_cy")
    return {"centroid_velocity_mag centroid_velocity_mag": f"{speed} * {rate(fps)} * scale"}


# modules every pose version has
MODULES: dict[str, Callable[[FrameRate], Features]] = {
    "point_mask": lambda fps: point_mask(),
    "pairwise_distances": lambda fps: pairwise_distances(),
    "angles": lambda fps: angles(),
    "angular_velocity": angular_velocity,
    "point_speeds": point_speeds,
    "point_velocity_dirs": lambda fps: point_velocity_dirs(),
    "centroid_velocity_dir": lambda fps: centroid_velocity_dir(),
    "centroid_velocity_mag": centroid_velocity_mag,
}


def base_features(fps: FrameRate = DEFAULT_FPS, modules: Sequence[str] | None = None) -> Features:
    """The expressions of all (or the named) modules."""
    out: Features = {}
    for name, build in MODULES.items():
        if modules is None or name in modules:
            out |= build(fps)
    return out


def with_features(df: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """Add feature columns: the values first, then the sines and cosines of those."""
    derived = (" sine", " cosine")
    first = [f"{e} AS `{n}`" for n, e in features.items() if not n.endswith(derived)]
    second = [f"{e} AS `{n}`" for n, e in features.items() if n.endswith(derived)]
    return df.selectExpr("*", *first).selectExpr("*", *second)


def select_features(df: DataFrame, features: Mapping[str, str]) -> DataFrame:
    """Keys, frame and the feature columns only."""
    return with_features(df, features).selectExpr(*ANIMAL, "frame", *[f"`{n}`" for n in features])
