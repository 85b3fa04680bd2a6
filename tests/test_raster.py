"""Filled contours against a pixel-by-pixel rendering."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.functions import raster


def plain_pixels(contours):
    """Set of pixels: outlines step by step, then every pixel row from crossing to crossing."""
    pixels, crossings = set(), {}
    for points in contours:
        for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
            a, b, c, d = (x0, y0, x1, y1) if x0 <= x1 else (x1, y1, x0, y0)
            wide, high, way = c - a, abs(d - b), 1 if d >= b else -1
            error, x, y = max(wide, high) - 2 * min(wide, high), a, b
            for _ in range(max(wide, high) + 1):
                pixels.add((x, y))
                sideways, error = error < 0, error - 2 * min(wide, high)
                error += 2 * max(wide, high) if sideways else 0
                if high > wide:
                    x, y = x + sideways, y + way
                else:
                    x, y = x + 1, y + way * sideways
            if y0 != y1:
                top, low = ((x0, y0), (x1, y1)) if y0 < y1 else ((x1, y1), (x0, y0))
                slope = int((low[0] - top[0]) * 65536 / (low[1] - top[1]))
                at = top[0] * 65536
                for y in range(top[1], low[1]):
                    crossings.setdefault(y, []).append(at)
                    at += slope
    for y, xs in crossings.items():
        xs.sort()
        for left, right in zip(xs[::2], xs[1::2]):
            pixels |= {(x, y) for x in range((left + 32768) >> 16, ((right + 32768) >> 16) + 1)}
    return pixels


def shapes():
    rng = random.Random(7)
    yield [[(3, 4), (43, 4), (43, 24), (3, 24)]]  # a rectangle of 40 by 20: 861 pixels
    yield [[(5, 5)]]
    yield [[(1, 1), (9, 1)]]
    yield [[(2, 9), (2, 0)]]
    yield [[(0, 0), (30, 0), (30, 30), (0, 30)], [(10, 10), (20, 10), (20, 20), (10, 20)]]  # a hole
    yield [[(0, 0), (10, 0), (10, 10), (0, 10)], [(50, 50), (60, 55), (52, 60)]]  # two pieces
    yield [[(0, 0), (10, 10), (10, 0), (0, 10)]]  # crosses itself
    for _ in range(150):
        yield [[(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))]


def test_runs_are_the_pixels():
    all_shapes = list(shapes())
    row = np.array([i for i, s in enumerate(all_shapes) for c in s for _ in c])
    points = np.array([p for s in all_shapes for c in s for p in c])
    sizes = np.array([len(c) for s in all_shapes for c in s])
    found = raster.filled_runs(row, points[:, 0], points[:, 1], np.cumsum(sizes) - sizes)
    pixels = [[] for _ in all_shapes]
    for r, y, x0, x1 in zip(*map(np.ndarray.tolist, found)):
        pixels[r] += [(x, y) for x in range(x0, x1 + 1)]
    want = [plain_pixels(s) for s in all_shapes]
    assert [len(p) for p in pixels] == [len(set(p)) for p in pixels]  # no pixel twice
    assert [set(p) for p in pixels] == want and len(want[0]) == 861
    moments = raster.run_moments(len(all_shapes), *found)
    for name, p, q in raster.RAW_MOMENTS:
        assert moments[name].tolist() == [sum(x**p * y**q for x, y in s) for s in want]


def test_moments_of_columns(spark):
    some = [s for s in shapes()][:12]
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in c] for c in s]) for i, s in enumerate(some)] + [(99, []), (100, [[]])]
    df = spark.createDataFrame(rows, "i int, contours array<array<struct<x:double,y:double>>>").repartition(3)
    found = {r.i: r.m for r in df.select("i", raster.filled_moments(F.col("contours")).alias("m")).collect()}
    for i, s in enumerate(some):
        pixels = plain_pixels(s)
        assert found[i].m00 == len(pixels) and found[i].m21 == pytest.approx(sum(x * x * y for x, y in pixels))
    assert found[99].m00 == found[100].m00 == 0


def test_moments_come_in_bounded_slices(monkeypatch):
    """Arrays follow STEPS, not the rows of a batch; slices give what the whole gives."""
    rng = np.random.default_rng(5)
    per_row = rng.integers(0, 4, 300)
    per_contour = rng.integers(0, 9, per_row.sum())
    x, y = rng.integers(0, 200, (2, per_contour.sum()))
    row = np.repeat(np.repeat(np.arange(len(per_row)), per_row), per_contour)
    whole = raster.run_moments(len(per_row), *raster.filled_runs(row, x, y, np.cumsum(per_contour) - per_contour))
    sizes, steps = [], raster._steps
    monkeypatch.setattr(raster, "_steps", lambda counts: sizes.append(int(counts.sum())) or steps(counts))
    for limit in (1, 5000, 1 << 30):
        sizes.clear()
        sliced = raster.sliced_moments(per_row, per_contour, x, y, limit)
        assert sliced.keys() == whole.keys() and all((sliced[n] == whole[n]).all() for n in whole)
        assert limit != 5000 or max(sizes) <= limit < sum(sizes)
    none = np.zeros(0, np.int64)
    assert all(len(v) == 0 for v in raster.sliced_moments(none, none, none, none).values())
    assert raster.STEPS <= 1 << 20
