"""Per-frame features of one animal relative to the others in view.

The animals of one frame meet in one row: a single shuffle on (video, frame), no self join and no
pair rows. A frame holds at most the animals of one arena, so that row stays small however long
or hot a video is. Hull distances come from one Arrow helper; which animal is nearest, and the
field of view, are column expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.functions import polygons
from ethospark.functions.angles import corner_angle, distance, sine_cosine, wrap
from ethospark.operators.base_features import Features
from ethospark.operators.frames import listed
from ethospark.operators.pose import BODY_COUNT, BODY_POINTS
from ethospark.skeleton import HALF_FIELD_OF_VIEW, INDEX, SOCIAL_KEYPOINTS

NOSE, NECK = INDEX["NOSE"], INDEX["BASE_NECK"]


def _frame_distances():
    """UDF: body points of all animals of a frame → matrix of hull distances (row-major)."""

    @F.pandas_udf("array<double>")
    def distances(points: pd.Series) -> pd.Series:
        # points: per frame a flat array of n animals x 20 numbers (10 x, then 10 y)
        width = 2 * len(BODY_POINTS)
        sizes = np.array([len(p) // width for p in points])
        flat = np.array(
            [np.nan if v is None else v for p in points for v in p], dtype=float
        ).reshape(-1, width)
        half = width // 2
        hx, hy, count = polygons.hulls(flat[:, :half], flat[:, half:])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        left = np.concatenate([np.repeat(np.arange(f, f + n), n) for f, n in zip(first, sizes)])
        right = np.concatenate([np.tile(np.arange(f, f + n), n) for f, n in zip(first, sizes)])
        upper = left < right
        value = np.zeros(len(left))
        a, b = left[upper], right[upper]
        value[upper] = polygons.hull_distance(hx[a], hy[a], hx[b], hy[b])
        out, at = [], 0
        for n in sizes:
            block = value[at : at + n * n].reshape(n, n)
            out.append((block + block.T).ravel())
            at += n * n
        return pd.Series(out)

    return distances


def nearest_animals(prepared: DataFrame) -> DataFrame:
    """Add ``near`` and ``near_fov``: structs (distance in pixels, identity, angle, points).

    The animal itself needs a hull, nose and neck; others need a hull. The nearest hull wins, the
    lowest identity on ties; ``near_fov`` looks only within the field of view. NULL if nobody.
    """
    body = ", ".join(f"IF(ok_{k}, {a}_{k}, NULL)" for a in "xy" for k in BODY_POINTS)
    social = ", ".join(f"named_struct('x', x_{INDEX[n]}, 'y', y_{INDEX[n]})" for n in SOCIAL_KEYPOINTS)
    rest = [c for c in prepared.columns if c not in ("video", "identity", "frame")]
    kept = prepared.selectExpr(
        "video", "frame",
        f"""struct(identity, {BODY_COUNT} >= 3 AS hull, present, cx, cy, array({social}) AS points,
            array({body}) AS body, struct({listed(rest)}) AS row) AS animal""",
    )
    frames = kept.groupBy("video", "frame").agg(
        F.expr("array_sort(collect_list(animal)) AS all")  # struct order: identity first
    )
    bodies = F.expr("flatten(transform(all, a -> a.body))")
    frames = frames.withColumn("apart", _frame_distances()(bodies))
    mine = frames.selectExpr("video", "frame", "all", "apart", "posexplode(all) AS (i, me)")
    angle = wrap(corner_angle(
        f"me.row.x_{NOSE}", f"me.row.y_{NOSE}", f"me.row.x_{NECK}", f"me.row.y_{NECK}", "o.cx", "o.cy"
    ))
    other = f"""named_struct('distance', apart[i * size(all) + j], 'identity', o.identity,
        'angle', {angle}, 'points', o.points, 'hull', o.hull)"""
    sees = f"me.present AND me.hull AND me.row.ok_{NOSE} AND me.row.ok_{NECK}"
    # structs compare field by field: distance, then identity
    return mine.selectExpr(
        "video", "frame", "me",
        f"""CASE WHEN {sees} THEN filter(transform(all, (o, j) -> {other}),
            o -> o.hull AND o.identity != me.identity) END AS others""",
    ).selectExpr(
        "video", "me.identity AS identity", "frame", "me.row.*", "array_min(others) AS near",
        f"array_min(filter(others, o -> abs(o.angle) <= {HALF_FIELD_OF_VIEW}D)) AS near_fov",
    )


def closest_ids() -> Features:
    """Side columns: identity of the nearest animal, overall and in view; -1 for none."""
    return {
        "closest_identities": "coalesce(near.identity, -1)",
        "closest_fov_identities": "coalesce(near_fov.identity, -1)",
    }


def closest_distances(scale: bool = False) -> Features:
    """Hull distances, in pixels unless ``scale`` is set."""
    unit = "scale" if scale else "1D"
    return {
        "closest_distances closest social distance": f"near.distance * {unit}",
        "closest_fov_distances closest social distance in FoV": f"near_fov.distance * {unit}",
    }


def closest_fov_angles() -> Features:
    return sine_cosine("closest_fov_angles angle of closest social distance in FoV", "near_fov.angle")


def social_pairwise() -> Features:
    """Distances between own and the nearest animal's nose, neck and tail base."""
    return {
        f"{module} social dist. {a}-{b}":
        distance(f"x_{INDEX[a]}", f"y_{INDEX[a]}", f"{near}.points[{j}].x", f"{near}.points[{j}].y") + " * scale"
        for module, near in (("social_pairwise_distances", "near"), ("social_pairwise_fov_distances", "near_fov"))
        for a in SOCIAL_KEYPOINTS
        for j, b in enumerate(SOCIAL_KEYPOINTS)
    }


def social_features() -> Features:
    return closest_distances() | closest_fov_angles() | social_pairwise()
