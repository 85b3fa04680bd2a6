"""Feature-matrix, cross-validation, training and project queries."""

import math

from pyspark.sql import functions as F

from ethospark.operators import classify as C
from ethospark.operators import crossval as X
from ethospark.operators import evaluate as E
from ethospark.operators import feature_table as FT
from ethospark.operators import labels as L
from ethospark.operators import matrix as M
from ethospark.operators import pose as P
from ethospark.operators import project as PR
from ethospark.operators.windows import quoted, window_features
from ethospark.plans.label_queries import _COUNTS, _counts
from ethospark.plans.pose_queries import _SCALE, scales
from ethospark.plans.registry import query, rounded
from ethospark.session import scratch_folder
from ethospark.skeleton import TRAINING_SEED
from ethospark.sources import tables as T

FRAME = M.FRAME
NUMBERS = ["n_letters", "left_words", "right_words", "LEFT_ratio", "right_RATIO"]

_MATRIX = """
    matrix AS (
        SELECT doc_id, source, lang, quality, toxic,
               length(text)::DOUBLE AS n_letters,
               len(string_split(text, ' '))::DOUBLE AS left_words,
               len(string_split(text, chr(10)))::DOUBLE AS right_words,
               CASE WHEN len(string_split(text, chr(10))) > 1 THEN
                 len(string_split(text, ' ')) / (len(string_split(text, chr(10))) - 1)::DOUBLE END AS "LEFT_ratio",
               CASE WHEN len(string_split(text, chr(10))) > 1 THEN
                 length(text) / len(string_split(text, ' '))::DOUBLE END AS "right_RATIO"
        FROM documents JOIN labels USING (doc_id))"""


def _numbers(df, *keep):
    return df.select(*keep, *[rounded(quoted(c)).alias(c) for c in NUMBERS])


_NUMBERS_SQL = ", ".join(f'round("{c}", 6) AS "{c}"' for c in NUMBERS)


# --- columns ---


def _column_names():
    return [
        "pairwise_distances NOSE-LEFT_EAR", "closest_distances closest social distance",
        "corner_distances distance to wall", "lixit_distances distance to lixit NOSE",
        "moments m00", "angles mean angle A", "angles psd_sum angle A", "moments fft_band-1.0Hz-3.0Hz m00",
    ]


@query(
    "matrix_selected_columns",
    """SELECT video, identity, frame, value AS "pairwise_distances NOSE-LEFT_EAR",
              value AS "corner_distances distance to wall", value AS "angles mean angle A"
       FROM v_signal""",
)
def matrix_selected_columns(v):
    """Settings without social, segmentation, lixit and spectral columns."""
    wide = v.signal().select(*FRAME, *[F.col("value").alias(n) for n in _column_names()])
    kept = M.selected_columns(
        wide.columns, social=False, segmentation=False, static_objects={"lixit": False}, fft=False
    )
    return wide.select(*map(quoted, kept))


@query(
    "matrix_model_columns",
    f'WITH {_MATRIX} SELECT doc_id, round("right_RATIO", 6) AS "right_RATIO", n_letters FROM matrix',
)
def matrix_model_columns(v):
    return M.model_columns(v.matrix(), ["right_RATIO", "n_letters"], ["doc_id"]).withColumn(
        "right_RATIO", rounded("right_RATIO")
    )


@query(
    "matrix_stack_common",
    """SELECT video, identity, frame, value FROM v_signal
       UNION ALL SELECT video, identity, frame, value FROM v_angle""",
)
def matrix_stack_common(v):
    left = v.signal().withColumn("only_here", F.lit(1))
    right = v.angle().withColumn("only_there", F.lit(2))
    return M.stack_common([left, right])


@query(
    "matrix_stack_videos",
    "SELECT video, identity, frame, value AS everywhere FROM v_signal",
)
def matrix_stack_videos(v):
    """A column that video3 has no values for is dropped from the stack."""
    rows = v.signal().withColumnRenamed("value", "everywhere")
    partly = F.when(F.col("video") != "video3", F.col("everywhere"))
    return M.stack_videos(rows.withColumn("partly", partly), ["everywhere", "partly"])


# --- rows ---

_SEEN = "SEMI JOIN v_present USING (video, identity, frame)"


@query(
    "matrix_labelled_rows",
    f"""SELECT video, identity, frame, value, label FROM v_signal
        JOIN v_label_b USING (video, identity, frame) {_SEEN}""",
)
def matrix_labelled_rows(v):
    return M.labelled_rows(v.signal(), v.label_b(), v.present())


@query(
    "matrix_classification_input",
    """SELECT s.video, s.identity, s.frame, value AS "signal value",
              round(avg(value) OVER (PARTITION BY s.video, s.identity ORDER BY s.frame
                    ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS "signal mean value",
              p.frame IS NOT NULL AS valid
       FROM v_signal s LEFT JOIN v_present p
         ON p.video = s.video AND p.identity = s.identity AND p.frame = s.frame""",
)
def matrix_classification_input(v):
    per_frame = v.signal().withColumnRenamed("value", "signal value")
    window = window_features(per_frame, ["video", "identity"], 5, ["signal value"], ops=["mean"])
    both = M.classification_input(per_frame, window, v.present())
    return both.withColumn("signal mean value", rounded(quoted("signal mean value")))


@query(
    "matrix_binary_training_rows",
    f"""SELECT video, identity, frame, value, label FROM v_signal
        JOIN (SELECT * FROM v_label_frame WHERE behavior = 'rest') l USING (video, identity, frame) {_SEEN}""",
)
def matrix_binary_training_rows(v):
    return M.binary_training_rows(v.signal(), v.label_frame(), v.present(), "rest")


@query(
    "matrix_multiclass_training_rows",
    f"""SELECT video, identity, frame, value,
               (CASE behavior WHEN 'None' THEN 0 WHEN 'walk' THEN 1 ELSE 2 END)::INT AS label
        FROM v_signal JOIN (SELECT * FROM v_label_multi WHERE label = 1) USING (video, identity, frame) {_SEEN}""",
)
def matrix_multiclass_training_rows(v):
    return M.multiclass_training_rows(v.signal(), v.label_multi(), v.present(), ["walk", "rest"])


def _clean_sql(c: str, forest: bool) -> str:
    # 1 / 0 is infinite and 0 / 0 is not a number: both are odd values in the matrix
    if forest:
        return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN 0 ELSE round(1 / {c}, 6) END"
    return f"CASE WHEN {c} = 0 THEN NULL ELSE round(1 / {c}, 6) END"


def _clean_query(learner: str) -> None:
    @query(
        f"matrix_clean_{learner}",
        f"""WITH {_MATRIX}, ends AS (SELECT doc_id, right_words - 1 AS d FROM matrix)
            SELECT doc_id, {_clean_sql('d', learner == 'random_forest')} AS inverse,
                   {'0.0::DOUBLE' if learner == 'random_forest' else 'NULL::DOUBLE'} AS odd
            FROM ends""",
    )
    def run(v):
        ends = v.matrix().withColumn("d", F.col("right_words") - 1)
        rows = ends.select(
            "doc_id",
            F.when(F.col("d") == 0, F.lit(float("inf"))).otherwise(1 / F.col("d")).alias("inverse"),
            F.lit(float("nan")).alias("odd"),
        )
        return M.clean(rows, ["inverse", "odd"], learner).withColumn("inverse", rounded("inverse"))


_clean_query("random_forest")
_clean_query("xgboost")


@query(
    "matrix_augment_symmetric",
    f"""WITH {_MATRIX} SELECT doc_id, {_NUMBERS_SQL} FROM matrix
        UNION ALL
        SELECT doc_id, round(n_letters, 6), round(right_words, 6), round(left_words, 6),
               round("right_RATIO", 6), round("LEFT_ratio", 6) FROM matrix""",
)
def matrix_augment_symmetric(v):
    return _numbers(M.augment_symmetric(v.matrix(), NUMBERS), "doc_id")


@query(
    "matrix_balance",
    f"""WITH {_MATRIX}, counts AS (SELECT quality, count(*) AS n FROM matrix GROUP BY quality)
    SELECT quality AS label, (SELECT min(n) FROM counts) AS n, (SELECT min(n) FROM counts) AS distinct_docs
    FROM counts""",
)
def matrix_balance(v):
    """Rows per class after balancing (which rows are kept depends on the seed)."""
    rows = v.matrix().withColumnRenamed("quality", "label")
    return M.balance(rows, ["doc_id"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("distinct_docs")
    )


@query(
    "matrix_balanced_rows",
    f"""WITH {_MATRIX}, counts AS (SELECT quality, count(*) AS n FROM matrix GROUP BY quality),
        drawn AS (
            SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', {TRAINING_SEED}, doc_id)), doc_id) AS place
            FROM matrix)
    SELECT doc_id, quality AS label, {_NUMBERS_SQL} FROM drawn WHERE place <= (SELECT min(n) FROM counts)""",
)
def matrix_balanced_rows(v):
    rows = v.matrix().withColumnRenamed("quality", "label")
    return _numbers(M.balance(rows, ["doc_id"]), "doc_id", "label")


# --- groups and splits ---


@query(
    "groups_individual",
    """SELECT DISTINCT video, identity, (dense_rank() OVER (ORDER BY video, identity) - 1)::INT AS group_id,
              video || ' ' || identity AS group_key FROM v_sequence""",
)
def groups_individual(v):
    return X.assign_groups(v.lengths(), "individual")


@query(
    "groups_video",
    """SELECT DISTINCT video, identity, (dense_rank() OVER (ORDER BY video) - 1)::INT AS group_id,
              video AS group_key FROM v_sequence""",
)
def groups_video(v):
    return X.assign_groups(v.lengths(), "video")


_PATTERN_VIDEO = "'cage_' || (user_id % 7) || '_' || user_id || '.mp4'"
_PATTERN_GROUPS = f"""
    files AS (SELECT DISTINCT CASE WHEN user_id % 5 = 0 THEN 'free_' || user_id || '.mp4'
                              ELSE {_PATTERN_VIDEO} END AS video, user_id AS identity FROM events),
    keyed AS (SELECT *, CASE WHEN video LIKE 'cage%' THEN split_part(video, '_', 2) ELSE video END AS group_key
              FROM files),
    firsts AS (SELECT group_key, min(video) AS first FROM keyed GROUP BY group_key),
    ids AS (SELECT group_key, (row_number() OVER (ORDER BY first) - 1)::INT AS group_id FROM firsts),
    named AS (SELECT video, identity, group_id, group_key FROM keyed JOIN ids USING (group_key))"""


def _files(v):
    cage = F.concat(F.lit("cage_"), F.col("user_id") % 7, F.lit("_"), F.col("user_id"), F.lit(".mp4"))
    free = F.concat(F.lit("free_"), F.col("user_id"), F.lit(".mp4"))
    return v.table("events").select(
        F.when(F.col("user_id") % 5 == 0, free).otherwise(cage).alias("video"),
        F.col("user_id").alias("identity"),
    ).distinct()


@query("groups_filename_pattern", f"WITH {_PATTERN_GROUPS} SELECT * FROM named")
def groups_filename_pattern(v):
    return X.assign_groups(_files(v), "filename_pattern", r"cage_(\d+)")


@query(
    "groups_excluded",
    f"""WITH {_PATTERN_GROUPS}
    SELECT group_id FROM named GROUP BY group_id
    HAVING bool_and(identity % 2 = 0 OR group_key = '3')""",
)
def groups_excluded(v):
    files = _files(v)
    out = files.filter((F.col("identity") % 2 == 0) | F.col("video").startswith("cage_3_"))
    return X.excluded_groups(X.assign_groups(files, "filename_pattern", r"cage_(\d+)"), out)


_VALIDITY = f"""{_MATRIX},
    counts AS (SELECT source AS g, quality AS label, count(*) AS n FROM matrix GROUP BY ALL),
    classes AS (SELECT DISTINCT label FROM counts),
    cells AS (
        SELECT g, label, coalesce(n, 0) AS n, g IN ('src3', 'src5') AS out
        FROM (SELECT DISTINCT g FROM counts) CROSS JOIN classes LEFT JOIN counts USING (g, label)),
    sides AS (
        SELECT *, sum(CASE WHEN out THEN 0 ELSE n END) OVER (PARTITION BY label)
                  - CASE WHEN out THEN 0 ELSE n END AS train FROM cells)"""


def _quality_counts(v):
    rows = v.matrix().withColumnsRenamed({"quality": "label", "source": "group_id"})
    return X.label_group_counts(rows)


def _held_out(v):
    return v.matrix().filter(F.col("source").isin("src3", "src5")).select(F.col("source").alias("group_id")).distinct()


@query(
    "splits_binary",
    f"""WITH {_VALIDITY}
    SELECT g AS group_id, sum(n)::BIGINT AS test_rows, count(*) FILTER (n >= 3) AS test_classes,
           bool_and(n >= 3 AND train >= 3) AS valid FROM sides GROUP BY g""",
)
def splits_binary(v):
    return X.split_validity(_quality_counts(v), _held_out(v), threshold=3)


@query(
    "splits_multiclass",
    f"""WITH {_VALIDITY}
    SELECT g AS group_id, sum(n)::BIGINT AS test_rows, count(*) FILTER (n >= 9) AS test_classes,
           bool_and(train >= 9) AND count(*) FILTER (n >= 9) >= 1 AS valid FROM sides GROUP BY g""",
)
def splits_multiclass(v):
    return X.split_validity(_quality_counts(v), _held_out(v), threshold=9, min_test_classes=1)


@query(
    "splits_count_valid",
    f"""WITH {_VALIDITY}, groups AS (
        SELECT g, bool_and(n >= 3 AND train >= 3) AS valid FROM sides GROUP BY g)
    SELECT count(*) FILTER (valid) AS valid_splits FROM groups""",
)
def splits_count_valid(v):
    return X.count_valid_splits(splits_binary(v))


@query(
    "gate_binary",
    f"""WITH {_COUNTS}, per_group AS (
        SELECT video, sum(fragmented_frames_behavior) AS yes, sum(fragmented_frames_not) AS no
        FROM counts WHERE behavior = 'rest' GROUP BY video)
    SELECT count(*) FILTER (yes >= 400 AND no >= 400) AS ready_groups FROM per_group""",
)
def gate_binary(v):
    counts = _counts(v).filter(F.col("behavior") == "rest")
    return X.binary_groups_ready(counts, "video", threshold=400)


@query(
    "gate_multiclass",
    f"""WITH {_COUNTS}, cells AS (
        SELECT video, identity, behavior, sum(fragmented_frames_behavior) AS n FROM counts GROUP BY ALL),
    totals AS (SELECT behavior, sum(n) AS total FROM cells GROUP BY behavior),
    groups AS (
        SELECT video, identity, count(*) FILTER (n >= 20) AS test,
               count(*) FILTER (total - n < 20) AS short
        FROM cells JOIN totals USING (behavior) GROUP BY video, identity)
    SELECT count(*) FILTER (test >= 2 AND short = 0) AS ready_groups FROM groups""",
)
def gate_multiclass(v):
    return X.multiclass_groups_ready(_counts(v), ["walk", "rest"])


@query(
    "matrix_included_rows",
    f"""WITH {_MATRIX} SELECT doc_id, source AS group_id FROM matrix
        WHERE source NOT IN ('src3', 'src5')""",
)
def matrix_included_rows(v):
    rows = v.matrix().select("doc_id", F.col("source").alias("group_id"))
    return M.included_rows(rows, _held_out(v)).select("doc_id", "group_id")


# --- scores ---


@query("scores_confusion", "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def scores_confusion(v):
    return E.confusion(v.table("labels"), "quality", "toxic")


@query("scores_accuracy", "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
def scores_accuracy(v):
    table = E.confusion(v.table("labels"), "quality", "toxic")
    return E.accuracy(table).select(rounded("accuracy").alias("accuracy"))


_CLASS_SCORES = """
    classes AS (SELECT quality AS cls FROM labels UNION SELECT toxic FROM labels),
    sums AS (
        SELECT cls, count(*) FILTER (quality = cls AND toxic = cls) AS hit,
               count(*) FILTER (toxic = cls) AS p, count(*) FILTER (quality = cls) AS t
        FROM classes CROSS JOIN labels GROUP BY cls),
    scores AS (
        SELECT cls, CASE WHEN p > 0 THEN hit / p ELSE 0 END AS precision,
               CASE WHEN t > 0 THEN hit / t ELSE 0 END AS recall,
               CASE WHEN p + t > 0 THEN 2 * hit / (p + t) ELSE 0 END AS f1, t AS support FROM sums)"""


@query(
    "scores_per_class",
    f"""WITH {_CLASS_SCORES}
    SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
    FROM scores""",
)
def scores_per_class(v):
    table = E.confusion(v.table("labels"), "quality", "toxic")
    return E.class_scores(table).select(
        "cls", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


@query(
    "scores_averaged",
    f"""WITH {_CLASS_SCORES}, pooled AS (SELECT avg((quality = toxic)::INT) AS a FROM labels)
    SELECT round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
           round(avg(f1), 6) AS f1_macro, round(any_value(a), 6) AS precision_micro,
           round(any_value(a), 6) AS recall_micro, round(any_value(a), 6) AS f1_micro
    FROM scores CROSS JOIN pooled""",
)
def scores_averaged(v):
    out = E.averaged_scores(E.confusion(v.table("labels"), "quality", "toxic"))
    return out.select(*[rounded(c).alias(c) for c in out.columns])


@query(
    "scores_fold_summary",
    """WITH folds AS (
        SELECT source, avg((quality = toxic)::INT) AS accuracy,
               CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN
                 count(*) FILTER (toxic = 1 AND quality = 1) / count(*) FILTER (toxic = 1) END AS precision
        FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT count(*) AS iterations, round(avg(accuracy), 6) AS accuracy_mean,
           round(avg(precision), 6) AS precision_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
           round(stddev_pop(precision), 6) AS precision_std FROM folds""",
)
def scores_fold_summary(v):
    """Every source as a fold; a fold without positive predictions has no precision (NaN)."""
    docs = v.table("documents").select("doc_id", "source").join(v.table("labels"), "doc_id")
    hit = F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1))
    positive = F.count_if(F.col("toxic") == 1)
    folds = docs.groupBy("source").agg(
        F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("accuracy"),
        F.when(positive > 0, hit / positive).otherwise(F.lit(float("nan"))).alias("precision"),
    )
    out = E.fold_summary(folds, ["accuracy", "precision"])
    return out.select("iterations", *[rounded(c).alias(c) for c in out.columns if c != "iterations"])


@query(
    "scores_derive_predictions",
    """WITH probs AS (
        SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 5) / 4.0 END AS a,
               CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 3) / 2.0 END AS b,
               CASE WHEN event_type = 'error' THEN 0 ELSE (event_id % 7) / 8.0 END AS c FROM events)
    SELECT event_id, (CASE WHEN greatest(a, b, c) = 0 THEN -1 WHEN a >= b AND a >= c THEN 0
                           WHEN b >= c THEN 1 ELSE 2 END)::INT AS cls,
           round(greatest(a, b, c)::DOUBLE, 6) AS confidence FROM probs""",
)
def scores_derive_predictions(v):
    part = lambda n, d: F.when(F.col("event_type") == "error", 0.0).otherwise((F.col("event_id") % n) / d)
    rows = v.table("events").select(
        "event_id", F.array(part(5, 4.0), part(3, 2.0), part(7, 8.0)).alias("probs")
    )
    return E.derive_predictions(rows).select("event_id", "cls", rounded("confidence").alias("confidence"))


# --- training ---


def _training_rows(v):
    return v.matrix().select(
        "doc_id", F.col("quality").alias("label"), "lang", *map(quoted, NUMBERS)
    )


@query("train_and_predict")
def train_and_predict(v):
    rows = _training_rows(v)
    model = C.train(rows, NUMBERS, ["doc_id"], symmetric=True, balanced=True, numTrees=10, maxDepth=4)
    out = E.derive_predictions(model.predict(rows))
    return out.select("doc_id", "label", "cls", rounded("confidence", 4).alias("confidence"))


@query("train_importance")
def train_importance(v):
    model = C.train(_training_rows(v), NUMBERS, ["doc_id"], numTrees=10, maxDepth=4)
    return v.spark.createDataFrame(model.importance(5), "feature string, importance double")


@query("cross_validate")
def cross_validate(v):
    groups = v.matrix().select("lang").distinct()
    rows = _training_rows(v).join(
        X.assign_groups(groups.select(F.col("lang").alias("video"), F.lit(0).alias("identity")), "video")
        .select(F.col("video").alias("lang"), "group_id"), "lang",
    ).persist()
    try:
        return C.cross_validate(
            rows, NUMBERS, ["doc_id"], k=2, threshold=3, balanced=True, numTrees=10, maxDepth=4
        )
    finally:
        rows.unpersist()


# Three classes that only the gaps of the features tell: nothing, the first or the second is missing.
_GAPS = """
    gaps AS (
        SELECT event_id, user_id % 3 AS group_id,
               CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS label FROM events)"""


def _gaps(v):
    kind = F.col("event_type")
    label = F.when(kind == "error", 1).when(kind == "signup", 2).otherwise(0)
    return v.table("events").select(
        "event_id", (F.col("user_id") % 3).alias("group_id"), label.alias("label"),
        F.when(label != 1, F.col("value")).alias("speed"), F.when(label != 2, F.col("value") * 2).alias("angle"),
        (F.col("event_id") % 17).cast("double").alias("noise"),
    )


def _recall(rows):
    """Rows per class, and whether nine of ten are found."""
    right = F.count_if(F.col("prediction") == F.col("label")) / F.count(F.lit(1))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("frames"), (right > 0.9).alias("learnt"))


@query(
    "train_boosted_gaps",
    f"WITH {_GAPS} SELECT (label > 0)::INT AS label, count(*) AS frames, TRUE AS learnt FROM gaps GROUP BY 1",
)
def train_boosted_gaps(v):
    """Boosted trees send missing values to the side that tells the classes apart."""
    rows = _gaps(v).withColumn("label", (F.col("label") > 0).cast("int"))
    model = C.train(rows, ["speed", "angle", "noise"], ["event_id"], "gradient_boosting", maxIter=2, maxDepth=2)
    return _recall(model.predict(rows))


@query("train_boosted_gaps_multiclass", f"WITH {_GAPS} SELECT label, count(*) AS frames, TRUE AS learnt FROM gaps GROUP BY label")
def train_boosted_gaps_multiclass(v):
    rows = _gaps(v)
    model = C.train(rows, ["speed", "angle", "noise"], ["event_id"], "gradient_boosting", maxIter=2, maxDepth=2)
    return _recall(model.predict(rows))


@query(
    "cross_validate_multiclass",
    f"WITH {_GAPS} SELECT group_id AS test_group, count(*) AS test_rows, TRUE AS learnt FROM gaps GROUP BY group_id",
)
def cross_validate_multiclass(v):
    """Every group is the test side of one fold; forests see 0 for a gap, which no present value is."""
    rows = _gaps(v).withColumns({c: F.col(c) + 1000 for c in ("speed", "angle")})
    out = C.cross_validate(
        rows, ["speed", "angle", "noise"], ["event_id"], k=math.inf, threshold=3, min_test_classes=2,
        balanced=True, numTrees=5, maxDepth=4,
    )
    return out.select("test_group", "test_rows", (F.col("accuracy") > 0.9).alias("learnt"))


@query(
    "train_predict_totals",
    f"""WITH {_MATRIX} SELECT quality AS label, count(*) AS documents, TRUE AS classes_known, TRUE AS confident
    FROM matrix GROUP BY quality""",
)
def train_predict_totals(v):
    """Every document has a class of the training and a confidence of at least one half."""
    out = train_and_predict(v)
    return out.groupBy("label").agg(
        F.count(F.lit(1)).alias("documents"), F.bool_and(F.col("cls").isin(0, 1)).alias("classes_known"),
        F.bool_and(F.col("confidence").between(0.5, 1)).alias("confident"),
    )


@query("classify_videos")
def classify_videos(v):
    """Poses → features → window features → model → class and confidence for every frame."""
    modules = ["angles", "centroid_velocity_dir", "centroid_velocity_mag", "corner_distances"]
    pose = v.stored(v.pose())
    per_frame = FT.per_frame_table(
        pose, v.static_object(), None, scales(v), version=5, object_names=["corners"], modules=modules
    )
    table = FT.training_matrix(per_frame, 2, fft=False)
    names = [c for c in table.columns if c not in (*FRAME, "present")]
    label = (F.element_at("embedding", 63) > 0).cast("int")
    labels = v.raw_instance().select("video", F.col("instance").alias("identity"), "frame", label.alias("label"))
    # the table feeds training and prediction, so it is stored once
    path = scratch_folder(v.spark, "features")
    T.write_features(table, path)
    rows = T.read_features(v.spark, path, names)
    model = C.train(rows.join(labels, FRAME), names, numTrees=5, maxDepth=4)
    out = model.predict_frames(rows, pose)
    return out.select(*FRAME, "cls", rounded("prob", 4).alias("prob"))


@query(
    "classify_videos_totals",
    """SELECT video, count(*) AS frames, count(h.frame) AS classified, TRUE AS confident
       FROM v_pose p LEFT JOIN v_pose_present h USING (video, identity, frame) GROUP BY video""",
)
def classify_videos_totals(v):
    """Every frame with the animal has a class and every other one has none."""
    has = F.col("cls") >= 0
    return classify_videos(v).groupBy("video").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(has).alias("classified"),
        F.bool_and(F.when(has, F.col("prob") >= 0.5).otherwise(F.col("prob") == 0)).alias("confident"),
    )


@query("features_all_modules")
def features_all_modules(v):
    """Every per-frame module at once (253 columns and the keys)."""
    contours = P.segments_by_identity(v.contour())
    return FT.per_frame_table(
        v.stored(v.pose()), v.static_object(), contours, scales(v), 8, ["corners", "lixit", "food_hopper"], 3
    )


# --- project reports ---


@query(
    "project_scan",
    f"""WITH {_SCALE}
    SELECT video, (max(frame) + 1)::INT AS num_frames, (max(identity) + 1)::INT AS num_identities,
           'corners,food_hopper,lixit' AS objects, 3 AS lixit_points, bool_or(s.video IS NOT NULL) AS has_scale
    FROM v_pose p LEFT JOIN scales s USING (video) GROUP BY video""".replace(
        "bool_or(s.video IS NOT NULL)", "bool_or(cm_per_pixel IS NOT NULL)"
    ),
)
def project_scan(v):
    found = PR.scan(v.pose(), v.static_object(), scales(v))
    return found.withColumn("objects", F.array_join("objects", ","))


@query(
    "project_capability",
    "SELECT 5 AS version, 'corners,lixit' AS objects, 3 AS lixit_points, 'pixel' AS unit",
)
def project_capability(v):
    """One video lacks the hopper and one lacks a scale."""
    objects = v.static_object().filter(~((F.col("video") == "v4") & (F.col("object") == "food_hopper")))
    scanned = PR.scan(v.pose(), objects, scales(v))
    versions = scanned.select("video", F.when(F.col("video") == "v2", 5).otherwise(6).alias("version"))
    return PR.capability(scanned, versions).withColumn("objects", F.array_join("objects", ","))


@query(
    "project_frame_mismatch",
    """SELECT video, (max(frame) + 1)::INT AS pose_frames, (max(frame) + 3)::INT AS video_frames
       FROM v_pose WHERE video IN ('v2', 'v7') GROUP BY video""",
)
def project_frame_mismatch(v):
    scanned = PR.scan(v.pose(), v.static_object(), scales(v))
    extra = F.when(F.col("video").isin("v2", "v7"), 2).otherwise(0)
    return PR.frame_count_mismatches(scanned, P.video_lengths(v.pose()).withColumn("num_frames", F.col("num_frames") + extra))


_META = """
    lengths AS (SELECT 'video' || (user_id % 7) AS video, user_id AS identity, count(*) AS n
                FROM events GROUP BY user_id),
    meta AS (
        SELECT video, identity, CASE WHEN n % 10 = 0 THEN 16 ELSE 17 END AS feature_version,
               n % 7 <> 0 AS per_frame_present,
               CASE WHEN video IN ('video0', 'video1') OR n % 13 = 0 THEN 0.05 END AS scale,
               CASE WHEN n % 11 = 0 THEN [2] WHEN n % 2 = 0 THEN [5, 10] ELSE [5] END AS window_sizes
        FROM lengths WHERE video <> 'video6'
        UNION ALL
        SELECT video, identity, 17, TRUE, NULL, [20] FROM lengths WHERE n % 3 = 0 AND video <> 'video6'),
    sized AS (SELECT DISTINCT video, identity, unnest(window_sizes) AS size FROM meta)"""


def _meta(v):
    n = F.col("num_frames")
    rows = v.lengths().filter(F.col("video") != "video6")
    own = rows.select(
        "video", "identity", F.when(n % 10 == 0, 16).otherwise(17).alias("feature_version"),
        (n % 7 != 0).alias("per_frame_present"),
        F.when(F.col("video").isin("video0", "video1") | (n % 13 == 0), F.lit(0.05)).alias("scale"),
        F.when(n % 11 == 0, F.array(F.lit(2))).when(n % 2 == 0, F.array(F.lit(5), F.lit(10)))
        .otherwise(F.array(F.lit(5))).alias("window_sizes"),
    )
    more = rows.filter(n % 3 == 0).select(
        "video", "identity", F.lit(17).alias("feature_version"), F.lit(True).alias("per_frame_present"),
        F.lit(None).cast("double").alias("scale"), F.array(F.lit(20)).alias("window_sizes"),
    )
    return own.unionByName(more)


def _expected(v):
    return v.lengths().groupBy("video").agg(F.count(F.lit(1)).alias("num_identities"))


@query(
    "project_feature_coverage",
    f"""WITH {_META},
    animals AS (SELECT video, identity, bool_or(per_frame_present) AS ok FROM meta GROUP BY ALL),
    totals AS (SELECT video, count(*) AS cached, count(*) FILTER (NOT ok) AS missing FROM animals GROUP BY video),
    caches AS (
        SELECT video, string_agg(DISTINCT feature_version::VARCHAR, ',' ORDER BY feature_version::VARCHAR) AS versions,
               bool_or(feature_version <> 17) AS stale,
               CASE WHEN count(scale) = count(*) THEN TRUE WHEN count(scale) = 0 THEN FALSE END AS cm
        FROM meta GROUP BY video),
    shares AS (SELECT video, size, count(*) AS n FROM sized GROUP BY ALL),
    lists AS (
        SELECT video, coalesce(string_agg(size::VARCHAR, ',' ORDER BY size) FILTER (n = cached), '') AS whole,
               coalesce(string_agg(size::VARCHAR, ',' ORDER BY size) FILTER (n < cached), '') AS partial
        FROM shares JOIN totals USING (video) GROUP BY video)
    SELECT e.video, coalesce(cached, 0) AS cached_identities, coalesce(missing, 0) AS missing_per_frame,
           coalesce(cached >= e.n AND missing = 0, FALSE) AS is_complete, coalesce(whole, '') AS window_sizes,
           coalesce(partial, '') AS partial_window_sizes, coalesce(versions, '') AS feature_versions,
           coalesce(stale, FALSE) AS is_stale, cm AS cm_units
    FROM (SELECT video, count(*) AS n FROM lengths GROUP BY video) e
    LEFT JOIN totals USING (video) LEFT JOIN caches USING (video) LEFT JOIN lists USING (video)""",
)
def project_feature_coverage(v):
    out = PR.feature_coverage(_meta(v), _expected(v))
    text = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), ",")
    return out.withColumns({c: text(c) for c in ("window_sizes", "partial_window_sizes", "feature_versions")})


@query(
    "project_videos_missing_window",
    f"""WITH {_META}
    SELECT DISTINCT video FROM lengths l WHERE n >= 60 AND NOT EXISTS (
        SELECT 1 FROM meta m WHERE m.video = l.video AND m.identity = l.identity
        AND m.feature_version = 17 AND m.per_frame_present AND list_contains(m.window_sizes, 5)
        AND (m.scale IS NOT NULL) = (l.video IN ('video0', 'video1')))""",
)
def project_videos_missing_window(v):
    required = v.lengths().filter(F.col("num_frames") >= 60)
    unit = v.num_frames().select("video", F.col("video").isin("video0", "video1").alias("expects_cm"))
    return PR.videos_missing_window(_meta(v), required, 5, unit)


@query("labels_multiclass_counts", "SELECT behavior, count(*) AS frames FROM v_label_multi WHERE label = 1 GROUP BY behavior")
def labels_multiclass_counts(v):
    """Training frames per class of an exclusive labelling."""
    classes = L.multiclass_labels(v.label_multi(), ["walk", "rest"])
    name = F.get(F.array(F.lit("None"), F.lit("walk"), F.lit("rest")), "cls")
    return classes.groupBy(name.alias("behavior")).agg(F.count(F.lit(1)).alias("frames"))
