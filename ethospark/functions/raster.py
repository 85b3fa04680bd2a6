"""Filled contours as runs of pixels, and moments over the runs.

The contours of a row are filled together by the even-odd rule, pixel row by pixel row, and their outlines are
drawn with eight-connected lines; both belong to the shape. Everything is a run (row, y, x0, x1): the fill
between two crossings, a stretch of an outline. Overlapping runs are merged, and a moment is a sum over
runs of ``y**q`` times a closed sum of ``x**p``, so the cost follows the outline and the height, not the area.

Coordinates are non-negative whole pixels (fractions are cut off). Crossings advance in fixed point
(1/65536 pixel) and are rounded half up, lines go left to right and round half towards their start, as the renderer does
whose moments are matched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The moments up to the third order as (name, power of x, power of y).
RAW_MOMENTS = [
    ("m00", 0, 0), ("m10", 1, 0), ("m01", 0, 1), ("m20", 2, 0), ("m11", 1, 1),
    ("m02", 0, 2), ("m30", 3, 0), ("m21", 2, 1), ("m12", 1, 2), ("m03", 0, 3),
]
_ONE = 1 << 16
STEPS = 1 << 17  # steps along outlines whose arrays are in memory at once (some 40 MB); one row is never cut


def _steps(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edge, 0 … count - 1) for each step of each edge."""
    edge = np.repeat(np.arange(len(counts)), counts)
    return edge, np.arange(len(edge)) - np.repeat(np.cumsum(counts) - counts, counts)


def _fill_runs(row, x0, y0, x1, y1):
    """Runs between the first and second, third and fourth … crossing of a pixel row."""
    slanted = y0 != y1
    row, x0, y0, x1, y1 = (v[slanted] for v in (row, x0, y0, x1, y1))
    down = y0 < y1
    top, bottom = np.where(down, y0, y1), np.where(down, y1, y0)
    left, right = np.where(down, x0, x1), np.where(down, x1, x0)
    run, height = right - left, bottom - top
    slope = np.sign(run) * (np.abs(run) * _ONE // height)
    edge, k = _steps(height)
    at, y = left[edge] * _ONE + k * slope[edge], top[edge] + k
    order = np.lexsort((at, y, row[edge]))
    pixel = (at[order] + _ONE // 2) >> 16
    return row[edge][order][::2], y[order][::2], pixel[::2], pixel[1::2]


def _line_runs(row, x0, y0, x1, y1):
    """Runs of the outline: for flat lines one per pixel row, for steep ones single pixels."""
    back = x1 < x0
    x0, x1, y0, y1 = np.where(back, x1, x0), np.where(back, x0, x1), np.where(back, y1, y0), np.where(back, y0, y1)
    wide, high, way = x1 - x0, np.abs(y1 - y0), np.sign(y1 - y0)
    edge, j = _steps(high + 1)
    a, b = wide[edge], high[edge]
    steep = b > a
    across = np.maximum(2 * b, 1)  # no division by zero for flat lines
    begin = np.where(j == 0, 0, -((a - 1 - 2 * a * j) // across))
    end = np.where(j == b, a, -((a - 1 - 2 * a * (j + 1)) // across) - 1)
    single = (2 * j * a + b - 1) // across
    begin, end = np.where(steep, single, begin), np.where(steep, single, end)
    return row[edge], y0[edge] + way[edge] * j, x0[edge] + begin, x0[edge] + end


def _following(contour_starts: np.ndarray, size: int) -> np.ndarray:
    """The vertex after each one along its contour."""
    following = np.arange(1, size + 1)
    ends = np.append(contour_starts[1:], size)
    some = ends > contour_starts
    following[ends[some] - 1] = contour_starts[some]
    return following


def filled_runs(row: np.ndarray, x: np.ndarray, y: np.ndarray, contour_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Disjoint runs (row, y, x0, x1) of the shapes; ``row`` is that of each vertex, contours follow each other."""
    if not len(x):
        return (np.zeros(0, np.int64),) * 4
    following = _following(contour_starts, len(x))
    edges = (row, x, y, x[following], y[following])
    row, y, x0, x1 = (np.concatenate(p) for p in zip(_fill_runs(*edges), _line_runs(*edges)))
    order = np.lexsort((x0, y, row))
    row, y, x0, x1 = (v[order] for v in (row, y, x0, x1))
    line = np.concatenate([[0], np.cumsum((row[1:] != row[:-1]) | (y[1:] != y[:-1]))])
    span = int(x1.max()) + 2
    reach = np.maximum.accumulate(line * span + x1)  # how far the runs of a line reach so far
    first = np.flatnonzero(np.concatenate([[True], line[1:] * span + x0[1:] > reach[:-1]]))
    return row[first], y[first], x0[first], np.maximum.reduceat(x1, first)


def _power_sum(p: int, n: np.ndarray) -> np.ndarray:
    """0**p + 1**p + … + n**p; n may be -1."""
    if p == 0:
        return n + 1
    if p == 1:
        return n * (n + 1) // 2
    if p == 2:
        return n * (n + 1) * (2 * n + 1) // 6
    return (n * (n + 1) // 2) ** 2


def run_moments(rows: int, row: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> dict[str, np.ndarray]:
    """Raw moments of each row's runs."""
    across = [(_power_sum(p, x1) - _power_sum(p, x0 - 1)).astype(float) for p in range(4)]
    return {name: np.bincount(row, across[p] * y.astype(float) ** q, rows) for name, p, q in RAW_MOMENTS}


def _slices(costs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into stretches of at most ``limit`` together, or of one row."""
    ends, begin = np.cumsum(costs), 0
    while begin < len(costs):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield begin, end
        begin = end


def sliced_moments(per_row: np.ndarray, per_contour: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int = STEPS) -> dict[str, np.ndarray]:
    """Raw moments of rows of ``per_row`` contours of ``per_contour`` vertices, a bounded number of steps at a time."""
    contours = np.concatenate([[0], np.cumsum(per_row)])
    points = np.concatenate([[0], np.cumsum(per_contour)])
    row = np.repeat(np.repeat(np.arange(len(per_row)), per_row), per_contour)
    steps = np.abs(y[_following(points[:-1], len(y))] - y) + 1
    parts = [run_moments(0, *filled_runs(row[:0], x[:0], y[:0], points[:0]))]
    for begin, end in _slices(np.bincount(row, steps, len(per_row)), limit):
        first, last = points[contours[begin]], points[contours[end]]
        starts = points[contours[begin] : contours[end]] - first
        runs = filled_runs(row[first:last] - begin, x[first:last], y[first:last], starts)
        parts.append(run_moments(end - begin, *runs))
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def filled_moments(contours: Column) -> Column:
    """Raw moments (a struct) of a list of contours, each a list of points (x, y)."""

    @F.arrow_udf(", ".join(f"{name} double" for name, _, _ in RAW_MOMENTS))
    def moments(column: pa.Array) -> pa.Array:
        lists = column.flatten()  # the contours of all rows
        points = lists.flatten()
        per_row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        per_contour = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        axes = dict(zip((f.name for f in points.type), points.flatten()))
        x, y = (axes[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy")
        found = sliced_moments(per_row, per_contour, x, y)
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], list(found))

    return moments(contours)
