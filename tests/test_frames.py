"""Sequence primitives against brute force, with pieces small enough to cut every run."""

import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.operators import frames as FR

KEY = ["identity"]


def brute_runs(vector):
    out, at = [], 0
    for value, group in groupby(vector):
        n = len(list(group))
        out.append((at, at + n - 1, value))
        at += n
    return out


@pytest.mark.parametrize("piece", [1, 3, 7, 1000])
def test_runs_with_neighbours(sequences, piece):
    rng = random.Random(piece)
    vectors = [[rng.choice([0, 0, 1, -1]) for _ in range(n)] for n in (1, 2, 30, 41)] + [[1] * 25]
    got = FR.runs(sequences(vectors), KEY, ["state"], piece=piece).collect()
    expected = set()
    for i, v in enumerate(vectors):
        found = brute_runs(v)
        for j, (s, e, value) in enumerate(found):
            before = found[j - 1][2] if j else None
            after = found[j + 1][2] if j + 1 < len(found) else None
            expected.add((i, s, e, value, before, after, e - s + 1))
    assert {(r.identity, r.start, r.end, r.state, r.prev_state, r.next_state, r.duration) for r in got} == expected
    assert len(got) == len(expected)


def test_runs_break_at_missing_frames(spark):
    rows = [(0, f, 1) for f in (0, 1, 2, 5, 6, 9)]
    df = spark.createDataFrame(rows, "identity int, frame int, state int")
    got = {(r.start, r.end, r.prev_state, r.next_state) for r in FR.runs(df, KEY, ["state"], piece=4).collect()}
    assert got == {(0, 2, None, None), (5, 6, None, None), (9, 9, None, None)}


def test_runs_sort_a_part_once(spark, capsys):
    """In the pieces and across them, beside no grouping that holds the runs again."""
    df = spark.createDataFrame([("a", f, f // 3 % 2) for f in range(40)], "k string, frame int, state int")
    FR.runs(df, ["k"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 2 and "Aggregate" not in plan


def test_intervals_longer_than_a_piece(spark):
    rows = [(0, 0, 9, 1), (0, 10, 10, 1), (0, 11, 30, 0), (0, 31, 31, 0), (0, 33, 40, 0)]
    df = spark.createDataFrame(rows, "identity int, start int, end int, state int")
    got = sorted((r.start, r.end, r.state) for r in FR.runs_of_intervals(df, KEY, piece=4).collect())
    assert got == [(0, 10, 1), (11, 31, 0), (33, 40, 0)]


@pytest.mark.parametrize("piece", [2, 5, 1000])
def test_sliding_window_crosses_pieces(sequences, piece):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=n).tolist() for n in (1, 4, 23)]
    df = sequences(vectors, "value", "double")
    out = FR.sliding(
        df, KEY, "frame", 3, 3, lambda w: {"total": F.sum("value").over(w.rangeBetween(-3, 3))}, piece
    ).collect()
    assert len(out) == 28
    for r in out:
        v = vectors[r.identity]
        assert r.total == pytest.approx(sum(v[max(0, r.frame - 3) : r.frame + 4]))


def test_neighbours_cross_pieces_but_not_gaps(spark):
    df = spark.createDataFrame([(0, f, float(f)) for f in (0, 1, 2, 4, 5)], "identity int, frame int, v double")
    rows = FR.with_neighbours(df, KEY, ["v"], piece=2).collect()
    got = {r.frame: (r.before and r.before.v, r.after and r.after.v) for r in rows}
    assert got == {0: (None, 1.0), 1: (0.0, 2.0), 2: (1.0, None), 4: (None, 5.0), 5: (4.0, None)}


@pytest.mark.parametrize("piece", [3, 1000])
def test_nearest_value(sequences, piece):
    vectors = [
        [None, None, 5, None, None, None, 7, None], [None] * 6, [1], [3, None, None, None, None, 4],
        [None] * 9 + [2],
    ]
    got = FR.nearest_value(sequences(vectors, "v"), KEY, "v", piece=piece).collect()
    for r in got:
        known = [(abs(f - r.frame), f, x) for f, x in enumerate(vectors[r.identity]) if x is not None]
        assert r.v_filled == (min(known)[2] if known else None)


def test_running_and_numbering(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(-5, 5)) for k in range(2) for i in range(20)]
    df = spark.createDataFrame(rows, "identity int, i int, x int")
    for how, fn in (("sum", sum), ("min", min), ("max", max)):
        for r in FR.running_before(df, KEY, "i", "x", how, "r", piece=3).collect():
            earlier = [x for k, i, x in rows if k == r.identity and i < r.i]
            assert r.r == (fn(earlier) if earlier else None)
    sparse = spark.createDataFrame([(0, i * i) for i in range(12)], "identity int, at int")
    numbered = FR.number_frames(sparse, KEY, ["at"], "floor(at / 10)", "n").collect()
    assert all(r.n**2 == r.at for r in numbered)


def test_spine_and_frames_of(spark):
    lengths = spark.createDataFrame([(0, 9), (1, 1), (2, 0)], "identity int, num_frames int")
    got = sorted(map(tuple, FR.spine(lengths, KEY, piece=4).collect()))
    assert got == [(0, f) for f in range(9)] + [(1, 0)]
    blocks = spark.createDataFrame([(0, 2, 12), (1, 5, 4)], "identity int, start int, end int")
    assert sorted(r.frame for r in FR.frames_of(blocks, piece=4).collect()) == list(range(2, 13))


def test_overlap_join_counts_each_pair_once(spark):
    rng = random.Random(5)
    make = lambda: [(rng.randint(0, 1), s := rng.randint(0, 60), s + rng.randint(0, 30)) for _ in range(25)]
    a, b = make(), make()
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "k int, s int, e int, i int")
    right = spark.createDataFrame([(*r, j) for j, r in enumerate(b)], "k int, start int, end int, j int")
    got = sorted((r.i, r.j) for r in FR.overlap_join(left, right, ["k"], ("s", "e"), ("start", "end"), cell=8).collect())
    expected = sorted(
        (i, j) for i, (k, s, e) in enumerate(a) for j, (k2, s2, e2) in enumerate(b) if k == k2 and s <= e2 and s2 <= e
    )
    assert got == expected


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.random(101), 1: rng.random(50), 2: np.zeros(30), 3: np.array([1.0]), 4: np.repeat([0.2, 0.9], 7)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v]
    got = FR.exact_median(spark.createDataFrame(rows, "k int, x double"), ["k"], "x", cells=16).collect()
    assert {r.k: pytest.approx(float(np.median(groups[r.k]))) for r in got} == {r.k: r.median for r in got}
    assert len(got) == len(groups)


def test_median_of_a_crowded_cell(spark):
    """A million different values in one cell of the first cut: no key's cell is ordered as a whole."""
    crowd = spark.range(1_000_000).selectExpr("0 AS k", "0.5D + id * 1e-12D AS x")
    more = spark.createDataFrame([(0, 0.0), (0, 1e9), (1, -3.0), (1, None), (2, 1e300), (2, -1e300)], "k int, x double")
    got = {r.k: r.median for r in FR.exact_median(crowd.unionByName(more), ["k"], "x", few=1000).collect()}
    assert got == {0: pytest.approx(0.5 + 499_999.5e-12, abs=1e-15), 1: -3.0, 2: 0.0}


def test_lookup_join_and_smallest_per_group(spark):
    big = spark.createDataFrame([(f"v{i % 2}", 0, i) for i in range(40)], "video string, identity int, frame int")
    small = spark.createDataFrame([("v0", 1.5)], "video string, scale double")
    out = FR.lookup_join(big, small, ["video"]).collect()
    assert len(out) == 40 and all((r.scale == 1.5) == (r.video == "v0") for r in out)
    few = FR.smallest_per_group(big, ["video"], ["frame"], 3, F.col("frame") % 5)
    assert sorted(r.frame for r in few.collect()) == [0, 1, 2, 3, 4, 5]


def test_running_total_by_ranges(spark):
    rows = [(i, 1 + i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, n long").repartition(7)
    out = FR.running_total(df, ["i"], "n", "before")
    assert {r.i: r.before for r in out.collect()} == {i: sum(n for _, n in rows[:i]) for i, _ in rows}
    assert FR.running_total(df.limit(0), ["i"], "n", "before").count() == 0
