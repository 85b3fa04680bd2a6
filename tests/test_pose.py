"""Pose normalisation, hulls and features."""

import heapq
import math
import random
from operator import itemgetter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ethospark.functions import polygons
from ethospark.operators import base_features as BF
from ethospark.operators import identities
from ethospark.operators import pose as P


def brute_identities(frames):
    """Frame by frame: free identities of ended tracks, then hand out the lowest one."""
    free = list(range(50))
    owner, last = {}, []
    for tracks in frames:
        for t in last:
            if t not in tracks:
                heapq.heappush(free, owner[t])
        for t in tracks:
            if t not in owner:
                owner[t] = heapq.heappop(free)
        last = tracks
    return owner


@pytest.mark.parametrize("gaps, at_once", [(False, 1 << 16), (True, 1 << 16), (False, 20), (True, 20)])
def test_track_allocation(spark, gaps, at_once):
    """By walks, and with most blocks handed out in pieces of eight frames."""
    rng = random.Random(7 + gaps)
    videos = {}
    for v in range(12):
        frames, live, number = [], {}, 0
        for _ in range(60):
            live = {t: n - 1 for t, n in live.items() if n > 1}
            while rng.random() < 0.35:
                live[number], number = rng.randint(1, 9), number + 1
            shown = [t for t in live if not (gaps and rng.random() < 0.15)]
            frames.append(shown)
        videos[f"v{v}"] = frames
    rows = [(v, f, t, i) for v, frames in videos.items() for f, ts in enumerate(frames) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "video string, frame int, track_id long, instance int")
    got = {(r.video, r.track_id): r.identity for r in P.allocate_identities(df, 8, at_once).collect()}
    expected = {(v, t): i for v, frames in videos.items() for t, i in brute_identities(frames).items()}
    assert got == expected


def test_allocation_of_a_hot_video_in_many_tasks(spark, monkeypatch):
    """One video with nine tenths of all tracks and one gap: no task sees more than its pieces."""
    rng, frames, live, number = random.Random(3), [], {}, 0
    for f in range(400):
        live = {t: n - 1 for t, n in live.items() if n > 1}
        while len(live) < 4 and rng.random() < 0.7:
            live[number], number = rng.randint(2, 40), number + 1
        frames.append([t for t in live if not (f == 30 and t == min(live))])
    rows = [("hot", f, t, i) for f, ts in enumerate(frames) for i, t in enumerate(ts)] + [("cold", f, 0, 0) for f in range(9)]
    df = spark.createDataFrame(rows, "video string, frame int, track_id long, instance int")
    pieces, too_large = (spark.sparkContext.accumulator(0) for _ in range(2))
    followed = identities._served

    def counted(tracks, entries):
        pieces.add(1)
        too_large.add(len(tracks) > 40)
        return followed(tracks, entries)

    monkeypatch.setattr(identities, "_served", counted)
    got = {(r.video, r.track_id): r.identity for r in P.allocate_identities(df, 32, 16).collect()}
    assert got == {("cold", 0): 0} | {("hot", t): i for t, i in brute_identities(frames).items()}
    assert number > 70 and pieces.value > 12 and too_large.value == 0


def test_pieces_are_one_stream():
    """500 pieces of four frames, some over two batches: what a task hands back is one batch, not one per piece."""

    def batches(rows, columns, size=7):
        return iter([pd.DataFrame(rows[i : i + size], columns=columns) for i in range(0, len(rows), size)])

    def only(results):
        (batch,) = results
        return list(batch.itertuples(index=False, name=None))

    dealt = ["unit", "cell", "track_id", "start", "instance", "end", "identity"]
    short = [("u", c, c, 4 * c, 0, 4 * c + 1, -1) for c in range(500)]
    long = [("u", c, 1000 + c, 4 * c + 2, 0, 4 * c + 5, -1) for c in range(500)]
    entries = [("u", c, 0, 4 * c + 1, 0, 4 * c + 1, 0) for c in range(1, 500)]
    in_order = itemgetter(1, 3)
    answers = only(identities._exits(batches(sorted(short + long + entries, key=in_order), dealt)))
    assert answers == sorted([("u", c, -1, 4 * c + 5) for c in range(500)] + [("u", c, 4 * c + 1, 4 * c + 5) for c in range(1, 500)])
    held = batches([(*a, -1, 3) for a in answers], ["unit", "cell", "held", "leaves", "since", "identity"])
    real = only(identities._walk(held, 4))
    assert real == [("u", 0, -1, 3)] + [("u", c, 4 * c + 1, 3) for c in range(1, 500)]
    entries = [("u", c, 0, h, 0, h, i) for _, c, h, i in real]
    marked = only(identities._marked(batches(sorted(short + long + entries, key=in_order), dealt), identities._served))
    assert {m[2] for m in marked if m[6] == 3} == {0, *range(1000, 1500)} and {m[6] for m in marked} == {3, -1}


@pytest.mark.parametrize("kind", ["int", "string"])
def test_allocation_in_pieces_keeps_the_kind_of_track_ids(spark, kind):
    rows = [("v", f, t, t % 2) for t in range(30) for f in range(3 * t, 3 * t + 5)]
    df = spark.createDataFrame(rows, "video string, frame int, track_id int, instance int")
    got = P.allocate_identities(df.withColumn("track_id", F.col("track_id").cast(kind)), 4, 1)
    assert dict(got.dtypes)["track_id"] == kind
    assert {int(r.track_id): r.identity for r in got.collect()} == {t: t % 2 for t in range(30)}


def test_identity_out_of_range_raises(spark):
    raw = spark.createDataFrame(
        [("v", 0, 0, 0, 3)], "video string, frame int, instance int, id_mask int, embed_id int"
    ).withColumn("keypoints", F.lit(1))
    centers = spark.createDataFrame([("v", 0), ("v", 1)], "video string, center int")
    with pytest.raises(Exception, match="out of range"):
        P.assign_identities(raw, centers=centers).collect()


def hull_of(points):
    """Monotone chain."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return half(points) + half(points[::-1])


def test_hulls_match_monotone_chain():
    rng = np.random.default_rng(0)
    for trial in range(60):
        p = rng.integers(0, 6 if trial % 2 else 1000, size=(10, 2)).astype(float)
        p[rng.random(10) < 0.2] = np.nan
        known = [tuple(q) for q in p if not np.isnan(q[0])]
        if len(known) < 3:
            continue
        hx, hy, count = polygons.hulls(p[None, :, 0], p[None, :, 1])
        assert set(zip(hx[0, : count[0]], hy[0, : count[0]])) == set(hull_of(known))


def test_hull_centroid_and_flat_hulls():
    square = np.array([[0.0, 0, 4, 4]]), np.array([[0.0, 2, 2, 0]])
    area, cx, cy = polygons.hull_area_centroid(*polygons.hulls(*square)[:2])
    assert (area[0], cx[0], cy[0]) == (8, 2, 1)
    flat = np.array([[1.0, 3, 7]]), np.array([[1.0, 3, 7]])
    area, cx, cy = polygons.hull_area_centroid(*polygons.hulls(*flat)[:2])
    assert (area[0], cx[0], cy[0]) == (0, 4, 4)


def test_hull_distance_against_sampling():
    rng = np.random.default_rng(3)
    outline = lambda hx, hy: np.concatenate([
        np.linspace(a, b, 200) for a, b in zip(np.column_stack([hx, hy]), np.roll(np.column_stack([hx, hy]), -1, axis=0))
    ])
    for _ in range(40):
        a, b = rng.random((2, 6, 2)) * 2
        b = b + rng.random(2) * 3
        ha, hb = (polygons.hulls(p[None, :, 0], p[None, :, 1]) for p in (a, b))
        d = polygons.hull_distance(ha[0], ha[1], hb[0], hb[1])[0]
        near = np.sqrt(((outline(ha[0][0], ha[1][0])[:, None] - outline(hb[0][0], hb[1][0])[None]) ** 2).sum(-1)).min()
        if d > 0:
            assert near == pytest.approx(d, abs=0.05)
        else:
            inside = polygons.hull_point_distance(ha[0], ha[1], hb[0][:, 0], hb[1][:, 0])[0] == 0
            assert near < 0.05 or inside or polygons.hull_point_distance(hb[0], hb[1], ha[0][:, 0], ha[1][:, 0])[0] == 0
    inner = polygons.hulls(np.array([[1.0, 2, 1]]), np.array([[1.0, 1, 2]]))
    outer = polygons.hulls(np.array([[0.0, 9, 0, 9]]), np.array([[0.0, 0, 9, 9]]))
    assert polygons.hull_distance(inner[0], inner[1], outer[0], outer[1])[0] == 0


def test_smallest_rectangle():
    angle = math.radians(30)
    corners = np.array([[0, 0], [6, 0], [6, 2], [0, 2]]) @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
    hx, hy, _ = polygons.hulls(corners[None, :, 0], corners[None, :, 1])
    short, long = polygons.smallest_rectangle(hx, hy)
    assert (short[0], long[0]) == (pytest.approx(2), pytest.approx(6))


@pytest.fixture(scope="module")
def walker(spark):
    """An animal walking right with all points in place, absent on frame 3."""
    rows = []
    for f in range(6):
        points = [(10.0 * f + k, 5.0 * (k % 3) + k, 0.0 if f == 3 else 1.0) for k in range(12)]
        rows.append(("v", 0, f, points))
    df = spark.createDataFrame(rows, "video string, identity int, frame int, keypoints array<struct<x:double,y:double,conf:double>>")
    return P.widen(df)


def test_gradient_edges_and_gaps(walker):
    features = BF.point_speeds(30.0) | BF.centroid_velocity_mag(30.0)
    rows = sorted(BF.select_features(BF.prepare(walker), features).collect(), key=lambda r: r.frame)
    speeds = [r["point_speeds NOSE speed"] for r in rows]
    # one-sided only at the video's ends; beside and on the missing frame there is no value, except
    # that frame 3 itself has both neighbours
    assert speeds == [300, 300, None, 300, None, 300]
    centroid = [r["centroid_velocity_mag centroid_velocity_mag"] for r in rows]
    assert [c is None for c in centroid] == [False, False, True, False, True, False]


def test_confidence_limit_is_strict(spark):
    points = [(1.0, 2.0, c) for c in [0.3, 0.31] + [0.0] * 10]
    schema = "video string, identity int, frame int, keypoints array<struct<x:double,y:double,conf:double>>"
    df = spark.createDataFrame([("v", 0, 0, points)], schema)
    row = P.widen(df).first()
    assert row.x_0 is None and row.x_1 == 1.0 and not row.ok_0 and row.ok_1
    kept = P.widen(df, keep_unsure=True).first()
    assert kept.x_0 == 1.0 and not kept.ok_0
    assert [P.with_presence(P.widen(df), v).first().present for v in (3, 4)] == [True, False]
