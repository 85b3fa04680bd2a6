"""Per-frame features relative to fixed objects of the arena: corners, lixits, food hopper.

Objects come as points (video, object, instance, point, x, y) and are folded into one small row per
video, which is joined to the frames with ``lookup_join``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.functions import polygons
from ethospark.functions.angles import corner_angle, distance, length, sine_cosine, wrap
from ethospark.operators.base_features import Features
from ethospark.operators.frames import lookup_join, nearest_value
from ethospark.operators.pose import ANIMAL, BODY_COUNT, body_arrays, body_columns
from ethospark.skeleton import BODY, INDEX, KEYPOINTS

NOSE, NECK, TAIL = INDEX["NOSE"], INDEX["BASE_NECK"], INDEX["BASE_TAIL"]


def bearing_to(tx: str, ty: str) -> str:
    """Turn from the neck→nose direction to a target, in [-180, 180)."""
    return wrap(corner_angle(f"x_{NOSE}", f"y_{NOSE}", f"x_{NECK}", f"y_{NECK}", tx, ty))


# --- arena ----------------------------------------------------------------------------------


def _ordered_points(objects: DataFrame, name: str) -> DataFrame:
    return objects.filter(F.col("object") == name).groupBy("video").agg(
        F.expr("array_sort(collect_list(struct(instance, point, double(x) AS x, double(y) AS y))) AS points")
    )


def clockwise_corners(objects: DataFrame) -> DataFrame:
    """Per video: corners ordered by angle about their mean; the first input corner stays first."""
    mean = "aggregate(points, 0D, (s, p) -> s + p.{0}) / size(points) AS center_{0}"
    around = """array_sort(transform(points, (p, i) -> named_struct(
        'a', atan2(p.x - center_x, p.y - center_y), 'i', i, 'x', p.x, 'y', p.y))) AS s"""
    first = "int(array_position(transform(s, c -> c.i), 0)) AS first"
    turned = """transform(concat(slice(s, first, size(s)), slice(s, 1, first - 1)),
        c -> named_struct('x', c.x, 'y', c.y)) AS corners"""
    return (
        _ordered_points(objects, "corners")
        .selectExpr("video", "points", mean.format("x"), mean.format("y"))
        .selectExpr("video", "center_x", "center_y", around)
        .selectExpr("*", first)
        .selectExpr("video", "center_x", "center_y", turned)
    )


def average_wall_length(objects: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """Mean side of the arena per video, in cm where a scale is known."""
    rows = clockwise_corners(objects)
    mean = f"{polygons.perimeter('corners')} / size(corners)"
    if scales is None:
        return rows.selectExpr("video", f"{mean} AS avg_wall_length")
    known = scales.selectExpr("video", "cm_per_pixel AS _s")
    return rows.join(known, "video", "left").selectExpr(
        "video", f"{mean} * coalesce(_s, 1D) AS avg_wall_length"
    )


def _hull_to_points(count: int):
    """UDF: body points, then ``count`` target points (all x, then all y) → distances."""

    @F.pandas_udf("array<double>")
    def distances(*batch: pd.Series) -> pd.Series:
        px, py = body_arrays(batch)
        hx, hy, _ = polygons.hulls(px, py)
        targets = [s.to_numpy(dtype=float) for s in batch[2 * len(BODY):]]
        found = [
            polygons.hull_point_distance(hx, hy, targets[i], targets[count + i]) for i in range(count)
        ]
        return pd.Series(list(np.column_stack(found)))

    return distances


def with_corners(prepared: DataFrame, objects: DataFrame) -> DataFrame:
    """Add the corner columns the modules below read (``corner`` struct, NULL if absent)."""
    rows = lookup_join(prepared, clockwise_corners(objects), ["video"])
    targets = [f"corners[{i}].x" for i in range(4)] + ["center_x"]
    targets += [f"corners[{i}].y" for i in range(4)] + ["center_y"]
    rows = rows.withColumn("_d", _hull_to_points(5)(*body_columns(), *map(F.expr, targets)))

    # wall i joins corner i and the corner before it; the raw cross products are rescaled so that
    # the smallest equals the distance to the outline
    def raw(i: int) -> str:
        p, q = f"corners[{i}]", f"corners[{(i + 3) % 4}]"
        return f"abs((cx - {p}.x) * ({q}.y - {p}.y) - (cy - {p}.y) * ({q}.x - {p}.x))"

    signed = polygons.signed_distance("cx", "cy", "_walls")
    return (
        rows.selectExpr(
            "*", "array_min(slice(_d, 1, 4)) AS _near", f"{polygons.edges('corners')} AS _walls",
            f"array({', '.join(raw(i) for i in range(4))}) AS _raw",
        )
        .selectExpr("*", "int(array_position(slice(_d, 1, 4), _near)) - 1 AS _which", f"{signed} AS _signed")
        .selectExpr(
            "*",
            f"""CASE WHEN present AND {BODY_COUNT} >= 3 AND corners IS NOT NULL THEN named_struct(
                'id', _which, 'distance', _near, 'center_distance', _d[4], 'wall', _signed,
                'x', corners[_which].x, 'y', corners[_which].y,
                'walls', transform(_raw, w -> abs(w * (_signed / array_min(_raw))))) END AS corner""",
        )
        .drop("_d", "_near", "_walls", "_raw", "_which", "_signed")
    )


def corner_distances() -> Features:
    return {
        "corner_distances distance to corner": "corner.distance * scale",
        "corner_distances distance to center": "corner.center_distance * scale",
        "corner_distances distance to wall": "corner.wall * scale",
    }


def corner_bearings() -> Features:
    to_corner = bearing_to("corner.x", "corner.y")
    to_center = f"CASE WHEN corner IS NOT NULL THEN {bearing_to('center_x', 'center_y')} END"
    return sine_cosine("corner_bearings bearing to corner", to_corner) | sine_cosine(
        "corner_bearings bearing to center", to_center
    )


def corner_side_columns() -> Features:
    """Closest corner (-1 for none) and the distance to each wall."""
    return {"closest_corners": "coalesce(corner.id, -1)"} | {
        f"wall_{i}": f"corner.walls[{i}] * scale" for i in range(4)
    }


# --- lixit (water spout) ----------------------------------------------------------------------


def lixits(objects: DataFrame) -> DataFrame:
    """Per video: lixits as array of (tip_x, tip_y, side_x, side_y); side is the middle of both sides.

    One-point lixits have a tip only.
    """
    single = objects.filter(F.col("object") == "lixit").groupBy("video", "instance").agg(
        *[F.max(F.when(F.col("point") == 0, F.col(a).cast("double"))).alias(f"tip_{a}") for a in "xy"],
        *[
            (F.sum(F.when(F.col("point").isin(1, 2), F.col(a).cast("double"))) / 2).alias(f"side_{a}")
            for a in "xy"
        ],
    )
    return single.groupBy("video").agg(
        F.array_sort(F.collect_list(F.struct("instance", "tip_x", "tip_y", "side_x", "side_y"))).alias("lixits")
    )


def with_lixit(prepared: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``lixit_id`` and ``lixit``: the one nearest to the hull centroid.

    Frames without centroid take the choice of the nearest frame in time (earlier on ties), and
    the first lixit if the animal never has one.
    """
    rows = lookup_join(prepared, lixits(objects), ["video"])
    away = f"transform(lixits, s -> {distance('cx', 'cy', 's.tip_x', 's.tip_y')})"
    rows = rows.selectExpr("*", f"CASE WHEN present AND cx IS NOT NULL THEN {away} END AS _away")
    rows = rows.selectExpr("*", "int(array_position(_away, array_min(_away))) - 1 AS lixit_choice")
    return (
        nearest_value(rows, ANIMAL, "lixit_choice")
        .selectExpr("*", "IF(lixits IS NOT NULL, coalesce(lixit_choice_filled, 0), NULL) AS lixit_id")
        .selectExpr("*", "get(lixits, lixit_id) AS lixit")
        .drop("_away", "lixit_choice", "lixit_choice_filled", "lixits")
    )


def lixit_distances() -> Features:
    return {
        f"lixit_distances distance to lixit {n}":
        distance(f"x_{k}", f"y_{k}", "lixit.tip_x", "lixit.tip_y") + " * scale"
        for k, n in enumerate(KEYPOINTS)
    }


def lixit_bearings() -> Features:
    return sine_cosine("lixit_bearings bearing to lixit", bearing_to("lixit.tip_x", "lixit.tip_y"))


def mouse_lixit_angle() -> Features:
    """Cosines between the lixit's axis and the animal's front and back halves."""
    lx, ly = "(lixit.tip_x - lixit.side_x)", "(lixit.tip_y - lixit.side_y)"

    def cosine(ax: str, ay: str) -> str:
        value = f"(({ax}) * {lx} + ({ay}) * {ly}) / ({length(ax, ay)} * {length(lx, ly)})"
        # least and greatest skip NULL, so a missing point needs its own branch
        return f"CASE WHEN present AND {value} IS NOT NULL THEN least(greatest({value}, -1D), 1D) END"

    return {
        "mouse_lixit_angle centroid - nose": cosine(f"x_{NOSE} - cx", f"y_{NOSE} - cy"),
        "mouse_lixit_angle base-tail - centroid": cosine(f"cx - x_{TAIL}", f"cy - y_{TAIL}"),
    }


# --- food hopper ----------------------------------------------------------------------------


def with_hopper(prepared: DataFrame, objects: DataFrame) -> DataFrame:
    """Add ``hopper``: the food hopper's edges."""
    outline = _ordered_points(objects, "food_hopper").selectExpr(
        "video", f"{polygons.edges('points')} AS hopper"
    )
    return lookup_join(prepared, outline, ["video"])


def food_hopper() -> Features:
    """Signed distance of each body point to the hopper outline, positive inside."""
    return {
        f"food_hopper food hopper {n}":
        f"({polygons.signed_distance(f'x_{INDEX[n]}', f'y_{INDEX[n]}', 'hopper')}) * scale"
        for n in BODY
    }
