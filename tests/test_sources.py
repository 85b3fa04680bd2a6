"""Names, documents, stored tables, clips."""

import pytest
from pyspark.sql import functions as F

from ethospark.functions import names as N
from ethospark.session import scratch_folder
from ethospark.sources import annotations as A
from ethospark.sources import poses as P
from ethospark.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    assert one(spark, N.pose_stem(F.lit("/a/b.c/cage_1_pose_est_v6.h5"))) == "cage_1"
    assert one(spark, N.pose_stem(F.lit("video.avi"))) == "video"
    assert one(spark, N.pose_version(F.lit("x_pose_est_v8.h5"))) == 8
    assert one(spark, N.safe_name(F.lit("__Größe  &/ x-1.5__"))) == "Größe_x-1.5"
    with pytest.raises(Exception, match="no usable"):
        one(spark, N.safe_name(F.lit("//")))
    ok = {t: one(spark, N.valid_tag(F.lit(t))) for t in ("a", "é_-9", "", "a b", "x" * 33, "x" * 32)}
    assert ok == {"a": True, "é_-9": True, "": False, "a b": False, "x" * 33: False, "x" * 32: True}


def test_lixits_come_in_threes(spark):
    schema = "video string, keypoints array<array<double>>"
    good = spark.createDataFrame([("v", [[float(i), 2.0 * i] for i in range(6)])], schema)
    rows = P.lixit_objects(good).collect()
    assert [(r.instance, r.point, r.x) for r in rows] == [(i // 3, i % 3, float(i)) for i in range(6)]
    with pytest.raises(Exception, match="threes"):
        P.lixit_objects(spark.createDataFrame([("v", [[1.0, 1.0]])], schema)).collect()


def test_documents_prefer_blocks_as_drawn(spark):
    text = (
        '{"file": "v", "num_frames": 9, "labels": {"0": {"walk": [{"start": 0, "end": 1, "present": true}]}}, '
        '"unfragmented_labels": {"0": {"walk": [{"start": 0, "end": 4, "present": true}]}}}'
    )
    old = text.replace('"unfragmented_labels"', '"other"')
    docs = A.parse_documents(spark.createDataFrame([("new", text), ("old", old)], "video string, json string"))
    assert {r.video: r.end for r in A.load_blocks(docs).collect()} == {"new": 4, "old": 1}


def test_parts_hold_the_document(spark):
    """One video has nearly all blocks; no part holds more of them than asked for."""
    blocks = spark.range(5000).selectExpr(
        "'hot' AS video", "id % 3 AS identity", "IF(id % 2 = 0, 'walk', 'rest') AS behavior",
        "CAST(20 * id AS INT) AS start", "CAST(20 * id + 9 AS INT) AS end", "id % 7 > 0 AS present",
    )
    lengths = spark.createDataFrame([("hot", 100_000), ("bare", 5)], "video string, num_frames int")
    tag = "named_struct('video', 'hot', 'start', start, 'end', end, 'tag', 't', 'color', 'c', 'description', 'd', 'identity', identity)"
    notes = blocks.limit(150).selectExpr(f"{tag} AS s").select("s.*")
    parts = A.write_document_parts(blocks, blocks.filter("start < 2000"), lengths, notes, size=100)
    documents = A.parse_documents(parts).cache()
    assert documents.count() == 51  # fifty of one, one of the other
    read = A.load_blocks(documents)
    assert sorted(map(tuple, read.drop("position").collect())) == sorted(map(tuple, blocks.collect()))
    per_part = read.groupBy(F.shiftright("position", 31)).count().collect()
    assert {r["count"] for r in per_part} == {100}
    assert A.load_blocks(documents, False).count() == 100
    assert documents.selectExpr("sum(size(doc.annotations)) AS n").first()["n"] == 150
    ordered = read.orderBy("identity", "behavior", "position").collect()
    assert ordered == sorted(ordered, key=lambda r: (r.identity, r.behavior, r.start))


def test_parts_compute_each_view_once(spark):
    """Numbering reads a view twice; putting the parts together does not read it again."""
    blocks = spark.range(20).selectExpr(
        "'v' AS video", "id AS identity", "'walk' AS behavior", "CAST(9 * id AS INT) AS start", "CAST(9 * id + 3 AS INT) AS end", "true AS present"
    )
    lengths = spark.createDataFrame([("v", 200)], "video string, num_frames int")
    parts = A.write_document_parts(blocks, blocks.filter("start > 50"), lengths, size=4)
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 4
    assert parts.count() == 5


def test_parts_of_kept_frames(spark):
    rows = [("v", 0, f, [[float(f), 1.0], [None if f % 2 else 3.0, 2.0]], 0.9 if f % 3 else 0.1) for f in range(40)]
    schema = "video string, identity int, frame_index long, keypoints array<array<double>>, confidence double"
    frames = spark.createDataFrame(rows, schema)
    whole = T.keypoint_annotations(frames, 0.5).first()
    parts = T.keypoint_annotation_parts(frames, 0.5, size=8).orderBy("part").collect()
    assert sum((p.kept_frame_indices for p in parts), []) == whole.kept_frame_indices and len(parts) == 5
    assert all(p.keypoints == whole.keypoints and p.mean_confidence == pytest.approx(whole.mean_confidence) for p in parts)
    assert T.keypoint_annotation_parts(frames.limit(0), 0.5).count() == 0


def test_clip_carries_the_last_sample(spark):
    lengths = spark.createDataFrame([("a", 30), ("b", 5)], "video string, num_frames int")
    starts = P.clip_starts(lengths, 10, 6)
    assert [tuple(r) for r in starts.collect()] == [("a", 5)]
    assert P.clip_starts(lengths, 10, 22).count() == 0 and P.clip_starts(lengths, 10, 0).count() == 0
    rows = spark.createDataFrame([("a", f, f * 10) for f in (1, 4, 5, 14, 15)], "video string, sample_frame int, n int")
    got = sorted((r.sample_frame, r.n) for r in P.clip_samples(rows, starts, 10, ["video"]).collect())
    assert got == [(0, 40), (0, 50), (9, 140)]


def test_prediction_kind_is_checked(spark):
    path = scratch_folder(spark, "kind")
    schema = "video string, identity int, frame int, behavior string, cls int, class_names array<string>"
    T.write_predictions(spark.createDataFrame([("v", 0, 0, "all", 1, ["a"])], schema), path)
    assert T.read_predictions(spark, path, "all", multiclass=True).count() == 1
    with pytest.raises(Exception, match="expected binary"):
        T.read_predictions(spark, path, "all").collect()


def test_upsert_replaces_only_named_folders(spark):
    path = scratch_folder(spark, "upsert")
    schema = "video string, identity int, frame int, behavior string, cls int"
    T.write_predictions(spark.createDataFrame([("v", 0, 0, "a", 1), ("v", 0, 0, "b", 1), ("w", 0, 0, "a", 1)], schema), path)
    T.write_predictions(spark.createDataFrame([("v", 0, 0, "a", 2)], schema), path)
    got = sorted((r.video, r.behavior, r.cls) for r in T.read_predictions(spark, path).collect())
    assert got == [("v", "a", 2), ("v", "b", 1), ("w", "a", 1)]


def test_report_numbers_round_ties_to_even(spark):
    rows = [("v", 0, 0, n - 1, n, k / n) for n, k in ((128, 1), (128, 3), (4, 1))]
    schema = "video string, identity int, start int, end int, duration int, missing_NOSE double"
    report = T.bout_report(spark.createDataFrame(rows, schema)).collect()
    expected = ["0.007812", "0.023438", "0.250000"]
    assert [r.nose_missing_pct for r in report] == [r.overall_missing_pct for r in report] == expected
    frames = spark.createDataFrame([("v", 0, 0.03125, None), ("v", 1, 0.5, 0.03125)], "video string, frame int, missing double, others_missing double")
    got = [tuple(r)[2:] for r in T.frame_report(frames).collect()]
    assert got == [("0.0312", "N/A"), ("0.5000", "0.0312")]


def test_unknown_learner_code(spark):
    old = spark.createDataFrame([("2", None)], "learner string, distance_unit string")
    with pytest.raises(Exception, match="unknown learner"):
        T.normalize_training_settings(old).collect()
