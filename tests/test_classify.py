"""Training, prediction, importance and cross-validation on data whose classes are known."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ethospark.operators import boosting
from ethospark.operators import classify as C
from ethospark.session import scratch_folder

COLUMNS = ["LEFT speed", "RIGHT speed", "noise"]
SMALL = {"random_forest": {"numTrees": 7, "maxDepth": 3}, "gradient_boosting": {"maxIter": 3, "maxDepth": 2}}


def table(spark, classes, groups=1, rows=60):
    """Class k has speeds around 10 k; noise tells nothing."""
    rng = random.Random(classes * 10 + groups)
    made = []
    for g in range(groups):
        for i in range(rows):
            label = i % classes
            left, right = (10.0 * label + rng.random() for _ in range(2))
            made.append((f"video{g}", 0, i, g, label, left, right, rng.random()))
    names = "video string, identity int, frame int, group_id int, label int, `LEFT speed` double, `RIGHT speed` double, noise double"
    return spark.createDataFrame(made, names).repartition(2)


@pytest.mark.parametrize("learner, classes", [("random_forest", 2), ("random_forest", 3), ("gradient_boosting", 2), ("gradient_boosting", 3)])
def test_separable_classes_are_learnt(spark, learner, classes):
    rows = table(spark, classes)
    model = C.train(rows, COLUMNS, learner=learner, symmetric=True, balanced=True, **SMALL[learner])
    out = model.predict(rows).collect()
    assert model.classes == classes and len(out) == 60
    assert all(r.prediction == r.label for r in out)
    assert all(len(r.probs) == classes and abs(sum(r.probs) - 1) < 1e-9 for r in out)
    assert all(max(r.probs) == r.probs[r.prediction] for r in out)


def test_importance_is_ranked(spark):
    found = C.train(table(spark, 2), COLUMNS, **SMALL["random_forest"]).importance(2)
    assert len(found) == 2 and found[0][1] >= found[1][1]
    assert {n for n, _ in found} <= {"LEFT speed", "RIGHT speed"}


def test_frames_without_a_row_have_no_class(spark):
    rows = table(spark, 2)
    frames = spark.createDataFrame([("video0", 0, f) for f in (0, 1, 60)], "video string, identity int, frame int")
    out = {r.frame: r for r in C.train(rows, COLUMNS, **SMALL["random_forest"]).predict_frames(rows, frames).collect()}
    assert [out[f].cls for f in (0, 1, 60)] == [0, 1, -1] and out[60].prob == 0


def test_one_class_and_unknown_learners_raise(spark):
    rows = table(spark, 2)
    with pytest.raises(ValueError, match="at least 2 classes"):
        C.train(rows.filter("label = 1"), COLUMNS)
    with pytest.raises(ValueError, match="unknown learner"):
        C.train(rows, COLUMNS, learner="xgboost")
    with pytest.raises(Exception, match="noise"):
        C.train(rows, COLUMNS, **SMALL["random_forest"]).predict(rows.drop("noise"))


def test_folds_are_drawn_by_seed_and_excluded_groups_only_test(spark):
    rows = table(spark, 2, groups=4)
    wrong = F.when(F.col("group_id") == 2, 1 - F.col("label")).otherwise(F.col("label"))  # would mislead if learnt from
    rows = rows.withColumn("label", wrong).cache()
    excluded = spark.createDataFrame([(2,)], "group_id int")
    run = {"excluded": excluded, "seed": 1, **SMALL["random_forest"]}
    every = C.cross_validate(rows, COLUMNS, k=math.inf, **run).collect()
    assert [r.fold for r in every] == [1, 2, 3, 4] and sorted(r.test_group for r in every) == [0, 1, 2, 3]
    assert all(r.accuracy == r.f1_macro == (0 if r.test_group == 2 else 1) and r.test_rows == 60 for r in every)
    two = C.cross_validate(rows, COLUMNS, k=2, **run).collect()
    assert [r.test_group for r in two] == [r.test_group for r in every][:2]


# --- boosted trees ---


def gaps(spark, classes, rows=400):
    """The label is told by which of two features are missing, never by their values."""
    rng = random.Random(classes)
    made = []
    for i in range(rows):
        label = i % classes
        a, b, c = (rng.random() for _ in range(3))
        made.append((f"video{i % 2}", 0, i, label, None if label == 1 else a, None if label == 2 else b, c if i % 5 else float("inf")))
    names = "video string, identity int, frame int, label int, a double, b double, c double"
    return spark.createDataFrame(made, names).repartition(3)


@pytest.mark.parametrize("classes", [2, 3])
def test_missing_values_are_learnt(spark, classes):
    rows = gaps(spark, classes)
    model = C.train(rows, ["a", "b", "c"], learner="gradient_boosting", maxIter=4, maxDepth=2)
    out = model.predict(rows).collect()
    assert sum(r.prediction == r.label for r in out) > 0.9 * len(out)
    assert all(len(r.probs) == classes and abs(sum(r.probs) - 1) < 1e-9 for r in out)
    assert model.importance(3)[-1][0] == "c" and model.importance(1)[0][0] in ("a", "b")


def plain_boosting(values, labels, edges, rounds, depth, rate=0.3, l2=1.0, least=1.0):
    """Margins of binary boosting by trying every split of every node, row by row."""
    n = len(values)
    share = sum(labels) / n
    margins = [math.log(share / (1 - share))] * n

    def grow(own, g, h, left):
        total_g, total_h = sum(g[i] for i in own), sum(h[i] for i in own)
        best = (0.0, None)
        if left:
            for f in range(len(values[0])):
                codes = {i: None if values[i][f] is None else sum(e < values[i][f] for e in edges[f]) for i in own}
                for b in sorted({c for c in codes.values() if c is not None}):
                    for missing_left in (False, True):
                        side = [i for i in own if (missing_left if codes[i] is None else codes[i] <= b)]
                        gl, hl = sum(g[i] for i in side), sum(h[i] for i in side)
                        if hl < least or total_h - hl < least:
                            continue
                        part = lambda a, c: a * a / (c + l2)
                        gain = round((part(gl, hl) + part(total_g - gl, total_h - hl) - part(total_g, total_h)) / 2, 9)
                        if gain > best[0]:
                            best = (gain, side)
        if best[1] is None:
            for i in own:
                margins[i] += -rate * total_g / (total_h + l2)
        else:
            chosen = set(best[1])
            grow(best[1], g, h, left - 1)
            grow([i for i in own if i not in chosen], g, h, left - 1)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        unit = lambda x: round(x * 2**20) / 2**20
        grow(range(n), [unit(p[i] - labels[i]) for i in range(n)], [unit(p[i] * (1 - p[i])) for i in range(n)], depth)
    return margins


def test_boosting_follows_the_plain_algorithm(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    rng = random.Random(11)
    values = [[rng.choice([None, rng.randrange(6)]) for _ in range(3)] for _ in range(150)]
    labels = [int(((v[0] or 0) + 2 * (v[1] is None) + rng.random() * 3) > 4) for v in values]
    rows = spark.createDataFrame(
        [(y, [None if x is None else float(x) for x in v]) for v, y in zip(values, labels)], "label int, features array<double>"
    )
    made = [boosting.fit(rows.repartition(n), 3, 2, max_iter=5, max_depth=3) for n in (1, 5)]
    assert [[t.feature.tolist() for t in r] for r in made[0].rounds] == [[t.feature.tolist() for t in r] for r in made[1].rounds]
    edges = [e.tolist() for e in made[0].edges]
    assert edges == [sorted({v[k] for v in values if v[k] is not None}) for k in range(3)]
    found = rows.select(made[0].probabilities(F.col("features")).alias("p")).collect()
    want = plain_boosting(values, labels, edges, 5, 3)
    assert all(r.p[1] == pytest.approx(1 / (1 + math.exp(-m)), abs=1e-6) for r, m in zip(found, want))


def test_features_without_values(spark):
    rows = spark.createDataFrame([(i % 2, [None, 1.0, float(i % 2)]) for i in range(40)], "label int, features array<double>")
    model = boosting.fit(rows, 3, 2, max_iter=1, max_depth=2)
    assert model.importance().tolist() == [0, 0, 1]


def test_vectors_are_written_once_for_all_folds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "scratch_folder", lambda s, name: written.append(name) or f"{scratch_folder(s, name)}")
    rows = table(spark, 3, groups=4)
    out = C.cross_validate(rows, COLUMNS, k=math.inf, symmetric=True, balanced=True, learner="gradient_boosting", **SMALL["gradient_boosting"]).collect()
    assert written == ["training-vectors"]
    assert [(r.fold, r.accuracy, r.test_rows) for r in out] == [(i, 1.0, 60) for i in (1, 2, 3, 4)]
    assert {n for r in out for n in r.top_features[:2]} <= set(COLUMNS)
    none = C.cross_validate(rows, COLUMNS, k=0, **SMALL["random_forest"])
    assert none.count() == 0 and "f1_macro" in none.columns
