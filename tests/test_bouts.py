"""Bout encoding, deletion and clean-up on small vectors."""

import random

import pytest
from pyspark.sql import functions as F

from ethospark.operators import bouts as B

KEY = ["identity"]


def decoded(df, count):
    out = [dict() for _ in range(count)]
    for r in df.collect():
        out[r.identity][r.frame] = r.state
    return [[v[f] for f in sorted(v)] for v in out]


def run(sequences, vectors, step):
    bouts = B.encode(sequences(vectors), KEY)
    return decoded(B.decode(step(bouts), KEY), len(vectors))


def spelled(*parts):
    return [state for state, n in parts for _ in range(n)]


def test_delete_literal_cases(sequences):
    # (vector, index to delete, expected)
    cases = [
        (spelled((0, 2), (1, 2), (0, 2)), [1], spelled((0, 6))),
        (spelled((0, 2), (1, 2), (2, 2)), [1], spelled((0, 3), (2, 3))),
        (spelled((0, 2), (1, 3), (2, 2)), [1], spelled((0, 3), (2, 4))),
        (spelled((0, 2), (1, 2), (0, 2)), [0], spelled((1, 4), (0, 2))),
        (spelled((0, 2), (1, 2), (0, 2)), [2], spelled((0, 2), (1, 4))),
        (spelled((0, 2), (1, 2), (0, 2), (2, 2), (0, 2)), [1, 3], spelled((0, 10))),
        ([1, 1, 1], [0], [1, 1, 1]),
    ]
    wanted = [(i, j) for i, (_, gone, _) in enumerate(cases) for j in gone]

    def step(bouts):
        hit = F.lit(False)
        for i, j in wanted:
            hit = hit | ((F.col("identity") == i) & (F.col("bout_id") == j))
        return B.delete(B.numbered(bouts, KEY), KEY, hit)

    assert run(sequences, [v for v, _, _ in cases], step) == [e for _, _, e in cases]


def settle(vector, gone):
    """Step-by-step deletion, last flagged bout first."""
    bouts = []
    for x in vector:
        if bouts and bouts[-1][0] == x:
            bouts[-1][1] += 1
        else:
            bouts.append([x, 1])
    flags = [gone(s, n, i) for i, (s, n) in enumerate(bouts)]
    for i in reversed([i for i, f in enumerate(flags) if f]):
        if len(bouts) == 1:
            continue
        if i == 0:
            bouts[1][1] += bouts.pop(0)[1]
        elif i == len(bouts) - 1:
            bouts[-2][1] += bouts.pop()[1]
        elif bouts[i - 1][0] == bouts[i + 1][0]:
            bouts[i - 1][1] += bouts[i][1] + bouts[i + 1][1]
            del bouts[i : i + 2]
        else:
            d = bouts.pop(i)[1]
            bouts[i - 1][1] += d // 2
            bouts[i][1] += d - d // 2
    return spelled(*bouts)


def test_delete_touching_matches_step_by_step(sequences):
    rng = random.Random(11)
    vectors = [[rng.choice([-1, 0, 1]) for _ in range(rng.randint(1, 40))] for _ in range(150)]
    vectors += [[0], [0, 1], [0, 1, 0, 1, 0, 1]]

    def step(bouts):
        rows = B.numbered(bouts, KEY)
        return B.delete_touching(rows, KEY, (F.col("duration") == 1) & (F.col("bout_id") % 5 != 3))

    expected = [settle(v, lambda s, n, i: n == 1 and i % 5 != 3) for v in vectors]
    assert run(sequences, vectors, step) == expected


def test_touching_bouts_raise_in_the_closed_form(sequences):
    bouts = B.encode(sequences([[0, 1, 2, 0]]), KEY)
    with pytest.raises(Exception, match="touching"):
        B.delete(bouts, KEY, F.col("state").isin(1, 2)).collect()


def test_stages(sequences):
    gap = [1, 1, 1, -1, -1, 1, 1, 1]
    assert run(sequences, [gap], lambda b: B.interpolate_gaps(3)(b, KEY)) == [[1] * 8]
    assert run(sequences, [gap], lambda b: B.interpolate_gaps(1)(b, KEY)) == [gap]
    # limits: stitching includes its limit, the duration filter keeps bouts of exactly its limit
    assert run(sequences, [[1, 0, 0, 1]], lambda b: B.stitch(2)(b, KEY)) == [[1] * 4]
    assert run(sequences, [[0, 1, 1, 0], [1, 1]], lambda b: B.drop_short(2)(b, KEY)) == [[0, 1, 1, 0], [1, 1]]
    assert run(sequences, [[0, 1, 0], [1]], lambda b: B.drop_short(2)(b, KEY)) == [[0, 0, 0], [0]]


def test_pipeline_order_and_switches(sequences):
    vector = [1, 1, 0, 1, 1, 0, 0, 0, 0, 0]
    stitch = {"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 2}}
    short = {"stage_name": "BoutDurationFilterStage", "parameters": {"min_duration": 5}}
    clean = lambda config: lambda b: B.clean_bouts(b, KEY, config)
    assert run(sequences, [vector], clean([stitch, short])) == [[1] * 5 + [0] * 5]
    assert run(sequences, [vector], clean([short, stitch])) == [[0] * 10]
    assert run(sequences, [vector], clean([{**short, "enabled": False}])) == [vector]


@pytest.mark.parametrize("config", [
    [{"stage_name": "Unknown", "parameters": {}}],
    [{"stage_name": "BoutStitchingStage"}],
    [{"stage_name": "BoutStitchingStage", "parameters": None}],
    [{"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 0}}],
    [{"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 2}, "more": 1}],
])
def test_bad_configurations(config):
    with pytest.raises(ValueError):
        B.build_stages(config)


def test_violations(spark):
    rows = [(0, 0, 0, 3, 1), (0, 1, 3, 2, 1), (0, 2, 6, 2, 0), (0, 3, 8, 0, 1), (0, 4, 7, 2, 0)]
    events = spark.createDataFrame(rows, "identity int, bout_id int, start int, duration int, state int")
    got = {r.bout_id: r.problem for r in B.violations(events, KEY).collect()}
    assert got == {1: "repeated state", 2: "gap or overlap", 3: "empty", 4: "not ascending"}


def test_clean_by_behavior_guards(spark):
    rows = [("v", 0, f, "walk", f % 2, None) for f in range(4)] + [("v", 0, f, "all", 1, ["a"]) for f in range(4)]
    df = spark.createDataFrame(
        rows, "video string, identity int, frame int, behavior string, cls int, class_names array<string>"
    )
    config = [{"stage_name": "BoutStitchingStage", "parameters": {"max_stitch_gap": 1}}]
    keys = ["video", "identity"]
    out = B.clean_by_behavior(df, keys, {"walk": config}).collect()
    assert {(r.frame, r.cls, r.cls_post) for r in out} == {(0, 0, 1), (1, 1, 1), (2, 0, 1), (3, 1, 1)}
    with pytest.raises(ValueError, match="without predictions"):
        B.clean_by_behavior(df, keys, {"run": config})
    with pytest.raises(ValueError, match="multi-class"):
        B.clean_by_behavior(df, keys, {"all": config})
