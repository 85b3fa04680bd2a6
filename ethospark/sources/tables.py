"""Stored tables: features, predictions, training sets, keypoints, run metadata, reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ethospark import schemas
from ethospark.operators.frames import PIECE, lookup_join, piece_of
from ethospark.operators.project import FEATURE_VERSION
from ethospark.operators.windows import quoted

ANIMAL = ["video", "identity"]
FRAME = [*ANIMAL, "frame"]
PIECE_ROWS = 1 << 20  # frames of one animal that go into one file

# Auxiliary columns written ahead of the features.
SIDE_COLUMNS = [
    "present", "closest_identities", "closest_fov_identities", "closest_corners", "closest_lixit",
    "wall_0", "wall_1", "wall_2", "wall_3",
]


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one folder come from few tasks, but a hot folder from many."""
    return df.repartition(*keys, piece_of("frame", PIECE_ROWS))


# --- features ------------------------------------------------------------------------------


def write_features(features: DataFrame, path: str, window_size: int | None = None) -> None:
    """Feature table by video (and window size): side columns first, then features by name."""
    side = [c for c in SIDE_COLUMNS if c in features.columns]
    names = sorted(c for c in features.columns if c not in (*FRAME, *side))
    rows = features.select(*map(quoted, [*FRAME, *side, *names]))
    folders = ["video"]
    if window_size is not None:
        rows, folders = rows.withColumn("window_size", F.lit(window_size)), ["window_size", "video"]
    (
        _spread(rows, ["video"]).sortWithinPartitions(*FRAME)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders).parquet(path)
    )


def read_features(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a feature table; only the wanted columns are read."""
    table = spark.read.parquet(path)
    return table if columns is None else table.select(*map(quoted, [*FRAME, *columns]))


def feature_status(requests: DataFrame, meta: DataFrame, version: int = FEATURE_VERSION) -> DataFrame:
    """Which requested (video, identity, pose_hash, scale) features can be loaded as they are.

    ``status`` is ``valid`` or the first reason to recompute: absent, version, pose, scale.
    """
    stored = meta.select(
        *ANIMAL, F.col("feature_version").alias("_version"), F.col("pose_hash").alias("_hash"),
        F.col("scale").alias("_scale"), F.lit(True).alias("_found"),
    )
    status = (
        F.when(F.col("_found").isNull(), "absent")
        .when(F.col("_version") != version, "version")
        .when(F.col("_hash") != F.col("pose_hash"), "pose")
        .when(~F.col("_scale").eqNullSafe(F.col("scale")), "scale")
        .otherwise("valid")
    )
    return requests.join(stored, ANIMAL, "left").withColumn("status", status).drop(
        "_version", "_hash", "_scale", "_found"
    )


# --- predictions -----------------------------------------------------------------------------


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Upsert: replaces the (video, behavior) folders that occur in ``predictions``."""
    (
        _spread(predictions, ["video", "behavior"])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("video", "behavior").parquet(path)
    )


def read_predictions(
    spark: SparkSession, path: str, behavior: str | None = None, multiclass: bool = False,
    identities: DataFrame | None = None,
) -> DataFrame:
    """Scan predictions of one behaviour (only its folders are read) or of all.

    Rows of the other kind (binary / multi-class) raise. Videos whose identities do not number
    ``num_identities`` are left out, as their file would be; ``unread_predictions`` lists them.
    """
    rows = spark.read.parquet(path)
    if behavior is not None:
        rows = rows.filter(F.col("behavior") == behavior)
    named = F.col("class_names").isNotNull() if "class_names" in rows.columns else F.lit(False)
    kind = "multi-class" if multiclass else "binary"
    wrong = F.raise_error(F.concat(F.lit(f"expected {kind} predictions in "), F.col("video")))
    rows = rows.withColumn(
        "video", F.when(named != F.lit(multiclass), wrong.cast("string")).otherwise(F.col("video"))
    )
    if identities is None:
        return rows
    matching = _identity_counts(rows, identities).filter(F.col("found") == F.col("num_identities"))
    return rows.join(matching.select("video", "behavior"), ["video", "behavior"], "left_semi")


def _identity_counts(rows: DataFrame, identities: DataFrame) -> DataFrame:
    found = rows.groupBy("video", "behavior").agg(F.count_distinct("identity").alias("found"))
    return found.join(identities.select("video", "num_identities"), "video", "left")


def unread_predictions(spark: SparkSession, path: str, identities: DataFrame, behavior: str | None = None) -> DataFrame:
    """(video, behavior, found, num_identities) of what ``read_predictions`` leaves out; videos that
    ``identities`` does not know have no ``num_identities``."""
    rows = spark.read.parquet(path)
    if behavior is not None:
        rows = rows.filter(F.col("behavior") == behavior)
    return _identity_counts(rows, identities).filter(~F.col("found").eqNullSafe(F.col("num_identities")))


# --- training sets -----------------------------------------------------------------------------

# Learner codes of older exports.
OLD_LEARNER_CODES = {1: "Random Forest", 3: "XGBoost"}


def write_training_set(
    spark: SparkSession, path: str, rows: DataFrame, groups: DataFrame, settings: Mapping,
    behavior: str | Sequence[str], learner: str, seed: int, min_pose_version: int,
    distance_unit: str = "CM",
) -> None:
    """Labelled features, group table and settings as three tables under ``path``.

    A list of behaviours marks a multi-class set; class 0 is the background. Rows and settings carry
    ``set_id``, a digest of the settings, so that tables of several sets can be put together.
    """
    multi = not isinstance(behavior, str)
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    names = ["None", *behavior] if multi else [behavior]
    record = (
        FEATURE_VERSION, min_pose_version, "multiclass" if multi else "binary", list(names), learner, seed,
        distance_unit, json.dumps(dict(settings), sort_keys=True),
    )
    set_id = hashlib.md5(json.dumps(record).encode()).hexdigest()
    rows.withColumn("set_id", F.lit(set_id)).write.mode("overwrite").parquet(f"{path}/rows")
    schema = (
        "set_id string, file_version int, min_pose_version int, mode string, behaviors array<string>, learner string, "
        "training_seed long, distance_unit string, settings string"
    )
    spark.createDataFrame([(set_id, *record)], schema).write.mode("overwrite").parquet(f"{path}/settings")


def read_training_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables; settings of older exports are brought up to date."""
    return {
        "rows": spark.read.parquet(f"{path}/rows"),
        "groups": spark.read.parquet(f"{path}/groups"),
        "settings": normalize_training_settings(spark.read.parquet(f"{path}/settings")),
    }


def normalize_training_settings(settings: DataFrame) -> DataFrame:
    """Old integer learner codes become names (unknown ones raise); a missing unit is PIXEL."""
    code = F.expr("try_cast(learner AS INT)")
    unknown = F.raise_error(F.concat(F.lit("unknown learner code "), F.col("learner"))).cast("string")
    name = F.when(code.isNull(), F.col("learner"))
    for old, new in OLD_LEARNER_CODES.items():
        name = name.when(code == old, new)
    return settings.withColumns({
        "learner": name.otherwise(unknown),
        "distance_unit": F.coalesce("distance_unit", F.lit("PIXEL")),
    })


# --- keypoint tables and run metadata -----------------------------------------------------------


def frame_keypoints(rows: DataFrame, keypoints: Column, confidence: Column, frame: str = "frame") -> DataFrame:
    """One row per frame: index, K x 2 points, confidence."""
    pairs = F.transform(keypoints, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))
    others = [c for c in ("video", "identity") if c in rows.columns]
    return rows.select(
        *others, F.col(frame).cast("bigint").alias("frame_index"), pairs.alias("keypoints"),
        confidence.cast("double").alias("confidence"),
    )


def keypoint_annotations(frames: DataFrame, threshold: float, keys: Sequence[str] = ANIMAL) -> DataFrame:
    """The aggregated form: mean points and confidence over the frames that are sure enough.

    Sums per keypoint are combined before the shuffle; only frame numbers are listed.
    """
    kept = frames.filter(F.col("confidence") >= threshold)
    # count of keypoints is a property of the data set, read from one row
    first = kept.select(F.size("keypoints").alias("n")).first()
    number = first["n"] if first else 0
    axis = lambda k, a: F.avg(F.get(F.get("keypoints", F.lit(k)), F.lit(a)))
    return kept.groupBy(*keys).agg(
        F.array(*[F.array(axis(k, 0), axis(k, 1)) for k in range(number)]).alias("keypoints"),
        F.array_sort(F.collect_list("frame_index")).alias("kept_frame_indices"),
        F.avg("confidence").alias("mean_confidence"),
    )


def keypoint_annotation_parts(
    frames: DataFrame, threshold: float, keys: Sequence[str] = ANIMAL, size: int = PIECE
) -> DataFrame:
    """The aggregated form in parts: a row lists the kept ones among ``size`` frames of an animal.

    ``part`` numbers the stretches of frames; those without a kept frame have no row. Mean points and
    confidence are those of the whole animal, as in ``keypoint_annotations``, from sums of the parts.
    """
    kept = frames.filter(F.col("confidence") >= threshold).withColumn("part", piece_of("frame_index", size))
    first = kept.select(F.size("keypoints").alias("n")).first()  # a property of the data set
    places = [(k, a) for k in range(first["n"] if first else 0) for a in range(2)]
    number = {f"_{k}_{a}": F.get(F.get("keypoints", F.lit(k)), F.lit(a)) for k, a in places} | {"_c": F.col("confidence")}
    parts = kept.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list("frame_index")).alias("kept_frame_indices"),
        *[F.sum(value).alias(name) for name, value in number.items()],
        *[F.count(value).alias(f"{name}_n") for name, value in number.items()],
    )
    totals = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for name in number for c in (name, f"{name}_n")])
    *mean, sure = [F.try_divide(name, f"{name}_n") for name in number]
    whole = totals.select(
        *keys, F.array(*[F.array(x, y) for x, y in zip(mean[::2], mean[1::2])]).alias("keypoints"),
        sure.alias("mean_confidence"),
    )
    return lookup_join(parts.select(*keys, "part", "kept_frame_indices"), whole, keys)


def inference_runs(records: DataFrame) -> DataFrame:
    """Run metadata rows in the stored schema; ``extra`` (a struct or map) becomes JSON text."""
    extra = F.coalesce(F.to_json("extra"), F.lit("{}")) if "extra" in records.columns else F.lit("{}")
    schema = StructType.fromDDL(schemas.INFERENCE_RUN)
    return records.withColumn("extra", extra).to(schema)


# --- reports ------------------------------------------------------------------------------------


def _decimals(value: Column, digits: int) -> Column:
    """The number as text, rounded by its exact binary value and to even on ties, as ``printf`` does.

    ``format_string`` rounds ties up, so 1/128 would become 0.007813."""

    @F.arrow_udf("string")
    def text(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f"{v:.{digits}f}" for v in values.to_pylist()], pa.string())

    return text(value.cast("double"))


def bout_report(per_bout: DataFrame) -> DataFrame:
    """Report rows of missing keypoints per bout, numbers as text with six decimals."""
    missing = [c for c in per_bout.columns if c.startswith("missing_")]
    overall = sum((F.col(c) for c in missing), F.lit(0.0)) / len(missing)
    text = lambda c: _decimals(c, 6)
    return per_bout.select(
        "video", "identity", F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), "duration",
        *[text(F.col(c)).alias(f"{c.removeprefix('missing_').lower()}_missing_pct") for c in missing],
        text(overall).alias("overall_missing_pct"),
    )


def frame_report(frames: DataFrame) -> DataFrame:
    """Report rows of selected frames, numbers as text with four decimals."""
    text = lambda c: _decimals(c, 4)
    return frames.select(
        "video", "frame", text(F.col("missing")).alias("labeled_identity_missing_pct"),
        F.when(F.col("others_missing").isNull(), "N/A").otherwise(text(F.col("others_missing")))
        .alias("other_identities_missing_pct"),
    )


def write_csv(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
