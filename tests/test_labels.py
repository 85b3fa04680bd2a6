"""Labels, merging and annotations."""

import pytest
from pyspark.sql import functions as F

from ethospark.operators import labels as L

TRACK = "video string, identity int, behavior string"


@pytest.fixture(scope="module")
def track(spark):
    def build(vectors, name="walk"):
        rows = [("v", i, name, f, x) for i, v in enumerate(vectors) for f, x in enumerate(v) if x != -1]
        return spark.createDataFrame(rows, f"{TRACK}, frame int, label int")

    return build


def test_blocks_round_trip_and_overwrite(spark):
    blocks = spark.createDataFrame(
        [("v", 0, "walk", 2, 6, True, 0), ("v", 0, "walk", 5, 8, False, 1)], f"{TRACK}, start int, end int, present boolean, seq int"
    )
    frames = L.blocks_to_frames(blocks, order="seq")
    got = sorted((r.start, r.end, r.present) for r in L.frames_to_blocks(frames).collect())
    assert got == [(2, 4, True), (5, 8, False)]


@pytest.mark.parametrize("vector, size, expected", [
    ([-1] * 25 + [1] * 25 + [0] * 25, 3, [-1, 1, 0]),
    ([1, 1, 1] + [-1] * 7, 2, [1, -1]),
    ([1, 1, 0, 0] + [-1] * 6, 2, [2, -1]),
    ([-1] * 5, 4, [-1, -1, 3, 3]),  # bins of two frames: 2, 2, 1 + padding, padding
])
def test_downsample(spark, track, vector, size, expected):
    lengths = spark.createDataFrame([("v", 0, "walk", len(vector))], f"{TRACK}, num_frames int")
    out = L.downsample(track([vector]), lengths, size).collect()
    assert [r.label for r in sorted(out, key=lambda r: r.bin)] == expected


def test_merge_strategies(track):
    a, b = track([[1, 0, 1, -1, -1]]), track([[0, 1, -1, 0, -1]])
    for strategy, expected in (
        ("BEHAVIOR_WINS", [1, 1, 1, 0]), ("NOT_BEHAVIOR_WINS", [0, 0, 1, 0]), ("DESTINATION_WINS", [1, 0, 1, 0]),
    ):
        out = L.merge(a, b, strategy).collect()
        assert [r.label for r in sorted(out, key=lambda r: r.frame)] == expected
    with pytest.raises(ValueError):
        L.merge(a, b, "NOBODY_WINS")


def test_multiclass(track):
    frames = track([[1, -1, -1]], "walk").unionByName(track([[-1, 1, -1]], "None")).unionByName(track([[-1, -1, 0]], "rest"))
    got = {r.frame: r.cls for r in L.multiclass_labels(frames, ["rest", "walk"]).collect()}
    assert got == {0: 2, 1: 0}
    clash = frames.unionByName(track([[1]], "rest"))
    with pytest.raises(Exception, match="conflicting"):
        L.multiclass_labels(clash, ["rest", "walk"]).collect()
    with pytest.raises(ValueError):
        L.multiclass_labels(frames, ["walk", "walk"])


def test_exclusive_edit_clears_other_tracks(spark, track):
    frames = track([[1, 1, 1, 1]], "walk")
    edits = spark.createDataFrame(
        [("v", 0, "rest", 1, 2, True, 0), ("v", 0, "rest", 2, 2, False, 1)],
        f"{TRACK}, start int, end int, positive boolean, seq int",
    )
    got = sorted((r.frame, r.behavior, r.label) for r in L.exclusive_edits(frames, edits).collect())
    assert got == [(0, "walk", 1), (1, "rest", 1), (2, "None", 1), (3, "walk", 1)]
    binary = sorted((r.frame, r.behavior, r.label) for r in L.exclusive_edits(frames, edits, False).collect())
    assert (1, "walk", 1) in binary and (1, "rest", 1) in binary and (2, "rest", 0) in binary


def test_painted_frames_are_dealt_to_many_parts(spark, track):
    """Also where they pack well: no task counts all frames of one long edit."""
    edits = spark.createDataFrame(
        [("v", 0, "walk", 0, 3999, True, 0)], f"{TRACK}, start int, end int, positive boolean, seq int"
    )
    for multiclass in (False, True):
        edited = L.exclusive_edits(track([[0, 0, 0]], "walk").limit(0), edits, multiclass)
        parts = edited.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) < 100


def test_rename_rejects_used_names(track):
    blocks = L.frames_to_blocks(track([[1, 1]], "walk"))
    assert L.rename_behavior(blocks, "walk", "run").first().behavior == "run"
    for name in ("walk", "None"):
        with pytest.raises(ValueError):
            L.rename_behavior(blocks, "rest", name)


def test_annotation_keys(spark):
    schema = "video string, start int, end int, tag string, identity int"
    stored = spark.createDataFrame([("v", 1, 2, "Feed", None), ("v", 1, 2, "Feed", 0)], schema)
    wanted = spark.createDataFrame([("v", 1, 2, "fEED", None)], schema)
    assert [r.identity for r in L.find_annotations(stored, wanted).collect()] == [None]
    assert [r.identity for r in L.find_annotations(stored, wanted, "left_anti").collect()] == [0]


def test_class_shares_with_fractional_bins(spark):
    runs = spark.createDataFrame([("v", 0, 2, 0), ("v", 3, 4, 1)], "video string, start int, end int, cls int")
    lengths = spark.createDataFrame([("v", 5)], "video string, num_frames int")
    got = {(r.bin, r.cls): round(r.share, 6) for r in L.class_shares(runs, lengths, 2, ["video"]).collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0}  # half a background frame in bin 1 does not count


def test_label_counts_fall_back_for_old_files(spark):
    schema = f"{TRACK}, start int, end int, present boolean"
    new = spark.createDataFrame([("new", 0, "walk", 0, 9, True)], schema)
    frag = spark.createDataFrame([("new", 0, "walk", 0, 3, True), ("old", 0, "walk", 0, 4, False)], schema)
    got = {r.video: r for r in L.label_counts(new, frag).collect()}
    assert got["new"].unfragmented_frames_behavior == 10 and got["new"].fragmented_frames_behavior == 4
    assert got["old"].unfragmented_frames_not == 5 and got["old"].unfragmented_bouts_not == 1


def test_labels_of_different_lengths_do_not_merge(spark):
    rows = spark.createDataFrame([("v", 0, 3, 1)], "video string, identity int, frame int, label int")
    lengths = [spark.createDataFrame([("v", 0, n)], "video string, identity int, num_frames int") for n in (9, 9, 8)]
    keys = ["video", "identity"]
    same = L.merge(rows, rows, "BEHAVIOR_WINS", keys, (lengths[0], lengths[1]))
    assert [tuple(r) for r in same.collect()] == [("v", 0, 3, 1)]
    with pytest.raises(Exception, match="different lengths"):
        L.merge(rows, rows, "BEHAVIOR_WINS", keys, (lengths[0], lengths[2])).collect()
