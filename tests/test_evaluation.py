"""Cross-validation, scores, detector metrics, search and remapping."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ethospark.operators import crossval as X
from ethospark.operators import evaluate as E
from ethospark.operators import keypoint_metrics as M
from ethospark.operators import matrix as MX
from ethospark.operators import search as S

# --- cross-validation ---


def group_counts(spark, cells):
    return spark.createDataFrame([(g, c, n) for g, per in cells.items() for c, n in per.items()], "group_id int, label int, n long")


def test_three_even_groups_give_three_splits(spark):
    counts = group_counts(spark, {g: {0: 25, 1: 25} for g in range(3)})
    assert X.count_valid_splits(X.split_validity(counts)).first().valid_splits == 3
    held_out = spark.createDataFrame([(0,), (1,)], "group_id int")
    valid = {r.group_id: r.valid for r in X.split_validity(counts, held_out).collect()}
    # excluded groups only ever test; group 2 would be left without training rows
    assert valid == {0: True, 1: True, 2: False}


def test_split_rules_match_brute_force(spark):
    rng = random.Random(2)
    for trial in range(4):
        cells = {g: {c: rng.choice([0, 5, 19, 20, 40]) for c in range(3)} for g in range(6)}
        cells = {g: {c: n for c, n in per.items() if n} for g, per in cells.items()}
        out = set(rng.sample(range(6), trial))
        excluded = spark.createDataFrame([(g,) for g in out], "group_id int")
        need = None if trial % 2 else 2
        got = {r.group_id: r.valid for r in X.split_validity(group_counts(spark, cells), excluded, 20, need).collect()}
        classes = {c for per in cells.values() for c in per}
        for g, per in cells.items():
            if not per:
                continue
            train = {c: sum(p.get(c, 0) for h, p in cells.items() if h != g and h not in out) for c in classes}
            tested = sum(per.get(c, 0) >= 20 for c in classes)
            expected = all(n >= 20 for n in train.values()) and tested >= (len(classes) if need is None else need)
            assert got[g] == expected


def test_resolve_splits_and_gates():
    assert [X.resolve_splits(k, 4) for k in (0, 2, 9, math.inf)] == [0, 2, 4, 4]
    assert X.resolve_splits(3, 0) == 0
    assert X.binary_ready(3, 2) and not X.binary_ready(1, 1) and not X.binary_ready(2, 3)
    assert X.multiclass_ready(1, ["a", "b"], 0) and not X.multiclass_ready(5, ["a"], 1)


def test_pattern_groups(spark):
    files = [("cage_12_a.mp4", 0), ("cage_12_b.mp4", 1), ("other.mp4", 0)]
    df = spark.createDataFrame(files, "video string, identity int")
    named = X.assign_groups(df, "filename_pattern", r"cage_(\d+)").collect()
    assert {(r.video, r.group_id, r.group_key) for r in named} == {
        ("cage_12_a.mp4", 0, "12"), ("cage_12_b.mp4", 0, "12"), ("other.mp4", 1, "other.mp4")
    }
    whole = X.assign_groups(df, "filename_pattern", r"cage_\d+").collect()
    assert {r.group_key for r in whole} == {"cage_12", "other.mp4"}
    for bad in ("", "("):
        with pytest.raises(ValueError):
            X.assign_groups(df, "filename_pattern", bad)


def test_balance_takes_each_row_once(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)], "id long, label int")
    out = MX.balance(rows, ["id"]).collect()
    assert sum(r.label for r in out) == 30 and len({r.id for r in out}) == len(out) == 60
    assert out != [] and sorted(out) == sorted(MX.balance(rows, ["id"]).collect())


def test_mirrored_columns():
    assert MX.mirrored_name("LEFT_EAR-right paw") == "right_ear-left paw"
    assert MX.is_circular("angles angle A") and not MX.is_circular("angles angle A sine")
    kept = MX.selected_columns(["video", "m fft_band-1.0Hz-3.0Hz x", "m mean x", "m x"], fft=False)
    assert kept == ["video", "m mean x", "m x"]


def test_scores_with_a_class_never_predicted(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 1)], "label int, prediction int")
    table = E.confusion(rows)
    scores = {r.cls: r for r in E.class_scores(table).collect()}
    assert scores[2].precision == 0 and scores[2].recall == 0 and scores[0].recall == 1
    assert scores[1].precision == 0 and scores[1].support == 1
    assert E.accuracy(table).first().accuracy == 0.5
    assert E.averaged_scores(table).first().recall_macro == pytest.approx(1 / 3)


# --- detector metrics ---


def boxes(spark, dets, truths):
    point = [(0.0, 0.0)]
    d = spark.createDataFrame(
        [(i, n, s, point, *b) for i, n, s, b in dets],
        "image int, det int, score double, points array<struct<x:double,y:double>>, x1 double, y1 double, x2 double, y2 double",
    )
    g = spark.createDataFrame(
        [(i, n, c, point, [1], *b) for i, n, c, b in truths],
        "image int, gt int, crowd boolean, points array<struct<x:double,y:double>>, visible array<int>, x1 double, y1 double, x2 double, y2 double",
    )
    return d, g


def test_perfect_and_half_recall(spark):
    box, far = (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)
    d, g = boxes(spark, [(0, 0, 0.9, box), (1, 0, 0.8, box)], [(0, 0, False, box), (1, 0, False, box)])
    assert all(r.ap == 1.0 and r.ar == 1.0 for r in M.evaluate(d, g).collect())
    d, g = boxes(spark, [(0, 0, 0.9, box)], [(0, 0, False, box), (0, 1, False, far)])
    summary = M.evaluation_summary(M.evaluate(d, g)).first()
    assert summary.ar == 0.5 and summary.ap_50 == pytest.approx(51 / 101)
    d, g = boxes(spark, [(0, 0, 0.9, box), (0, 1, 0.8, far)], [(0, 0, False, box), (0, 1, True, far)])
    assert all(r.ap == 1.0 for r in M.evaluate(d, g).collect())  # the crowd region takes the second one


def greedy(sim, scores, crowd, threshold):
    taken, out = set(), {}
    for d in sorted(range(len(scores)), key=lambda i: -scores[i]):
        best, at = threshold, None
        for g in range(len(crowd)):
            if not crowd[g] and g not in taken and sim[d][g] >= best:
                best, at = sim[d][g], g
        if at is not None:
            taken.add(at)
        ignored = at is None and any(crowd[g] and sim[d][g] >= threshold for g in range(len(crowd)))
        out[d] = (at, ignored)
    return out


@pytest.mark.parametrize("part", [2, 4096])
def test_matching(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    rng = np.random.default_rng(5)
    images = []
    for _ in range(12):
        n, m = rng.integers(1, 9, 2)
        # coarse values, so that ties are common
        images.append((rng.integers(0, 5, (n, m)) / 4, rng.integers(0, 4, n) / 4, rng.random(m) < 0.2))
    pairs = [
        (i, d, g, float(s[d]), bool(c[g]), float(sim[d][g]))
        for i, (sim, s, c) in enumerate(images) for d in range(len(s)) for g in range(len(c))
    ]
    table = spark.createDataFrame(pairs, "image int, det int, gt int, score double, crowd boolean, similarity double")
    dets = table.select("image", "det", "score").distinct()
    for r in M.greedy_match(table, dets, [0.5, 0.75]).collect():
        sim, s, c = images[r.image]
        assert (r.gt, r.ignored) == greedy(sim, s, c, r.threshold)[r.det]


def test_matching_one_image_of_chained_conflicts(spark):
    """Each detection prefers the truth that a stronger one takes, so refusals go round by round."""
    n = 9
    pairs = [(0, d, g, 1.0 - d / 100, False, 0.9 - abs(g - d + 1) / 50) for d in range(n) for g in range(n)]
    table = spark.createDataFrame(pairs, "image int, det int, gt int, score double, crowd boolean, similarity double")
    sim = [[0.9 - abs(g - d + 1) / 50 for g in range(n)] for d in range(n)]
    expected = greedy(np.array(sim), np.array([1.0 - d / 100 for d in range(n)]), np.array([False] * n), 0.5)
    got = M.greedy_match(table, table.select("image", "det", "score").distinct(), [0.5]).collect()
    assert {r.det: (r.gt, r.ignored) for r in got} == expected and len(got) == n


def test_rounds_of_matching_grow_with_the_parts_of_an_image(spark, monkeypatch):
    """One image holds all detections, in a chain of refusals much longer than its parts are many."""
    n = 600
    pairs = [(0, d, g, 1.0 - d / 1000, False, 0.9 - (g - d + 1) / 50) for d in range(n) for g in range(max(0, d - 1), min(n, d + 3))]
    table = spark.createDataFrame(pairs, "image int, det int, gt int, score double, crowd boolean, similarity double")
    sim = np.zeros((n, n))
    for _, d, g, _, _, value in pairs:
        sim[d, g] = value
    expected = greedy(sim, np.array([1.0 - d / 1000 for d in range(n)]), np.array([False] * n), 0.5)
    monkeypatch.setattr(M, "PART", 100)
    parts = M._in_parts(table.withColumn("threshold", F.lit(0.5)))
    sizes = [r["n"] for r in parts.groupBy("_part").agg(F.countDistinct("det").alias("n")).collect()]
    assert sizes == [100] * 6
    rounds, inside = [], M._proposals
    monkeypatch.setattr(M, "_proposals", lambda pairs: rounds.append(1) or inside(pairs))
    got = M.greedy_match(table, table.select("image", "det", "score").distinct(), [0.5]).collect()
    assert {r.det: (r.gt, r.ignored) for r in got} == expected and len(rounds) <= 6


def test_oks(spark):
    schema = "p array<struct<x:double,y:double>>, t array<struct<x:double,y:double>>, v array<int>, a double"
    df = spark.createDataFrame([([(0.0, 3.0), (9.0, 9.0)], [(0.0, 0.0), (0.0, 0.0)], [2, 0], 10.0)], schema)
    value = df.select(M.oks(F.col("p"), F.col("t"), F.col("v"), F.col("a"), [0.5, 0.5])).first()[0]
    assert value == pytest.approx(math.exp(-9 / (1 * 2 * 10)))
    assert df.select(M.oks(F.col("p"), F.col("t"), F.expr("array(0, 0)"), F.col("a"), [0.5, 0.5])).first()[0] == 0


# --- search ---


def predictions(spark, cls, prob):
    rows = [("v", 0, "walk", f, c, p) for f, (c, p) in enumerate(zip(cls, prob))]
    return spark.createDataFrame(rows, "video string, identity int, behavior string, frame int, cls int, prob double")


def test_search_runs(spark):
    df = predictions(spark, [1, 1, 0, 1, 1], [0.9] * 5)
    spans = lambda **k: sorted((r.start_frame, r.end_frame) for r in S.search_predictions(df, **k).collect())
    assert spans() == [(0, 1), (3, 4)]
    assert spans(kind="negative") == [(2, 2)]
    assert spans(kind="range", at_most=0.5) == [(2, 2)]
    assert spans(kind="range", at_least=0.5) == [(0, 1), (3, 4)]
    assert spans(shortest=3) == []
    with pytest.raises(ValueError):
        S.search_predictions(df, "sideways")


def test_hit_order(spark):
    schema = "file string, identity string, behavior string, start_frame int, end_frame int"
    hits = spark.createDataFrame([("a", "10", "w", 0, 1), ("a", "9", "w", 0, 1), ("a", "2", "w", 5, 6)], schema)
    assert [r.identity for r in S.ordered_hits(hits).collect()] == ["9", "10", "2"]
    named = hits.unionByName(spark.createDataFrame([("a", "x", "w", 0, 1)], schema))
    assert [r.identity for r in S.ordered_hits(named).collect()] == ["10", "9", "x", "2"]


@pytest.mark.parametrize("n, apart", [(5, 3), (40, 4), (3, 0), (3, 1)])
def test_top_frames_is_the_full_greedy_choice(spark, n, apart):
    rng = random.Random(n)
    rows = [(f"v{rng.randint(0, 1)}", f, rng.randint(0, 4) / 4, 0.0) for f in range(120)]
    df = spark.createDataFrame(rows, "video string, frame int, missing double, others_missing double")
    chosen = []
    for video, frame, missing, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(chosen) < n and all(v != video or abs(f - frame) >= max(apart, 1) for v, f in chosen):
            chosen.append((video, frame))
    assert sorted((r.video, r.frame) for r in S.top_frames(df, n, apart).collect()) == sorted(chosen)
