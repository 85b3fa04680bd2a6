"""Training, prediction and cross-validation.

Random forests are those of ``pyspark.ml`` and see 0 for missing values; boosted trees are ``boosting``, whose
splits send missing values to a learnt side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ethospark.operators import boosting, crossval, evaluate
from ethospark.operators.boosting import BoostedTrees
from ethospark.operators.matrix import augment_symmetric, balance, clean, model_columns
from ethospark.operators.windows import quoted
from ethospark.session import scratch_folder
from ethospark.skeleton import LABEL_THRESHOLD, TRAINING_SEED

FRAME = ["video", "identity", "frame"]
FOLDS_AT_ONCE = 4  # folds whose jobs run beside each other


def _forest(vectors: DataFrame, width: int, classes: int, seed: int, **params) -> Model:
    return RandomForestClassifier(**{"numTrees": 100, "maxDepth": 10, "seed": seed, **params}).fit(vectors)


def _boosted(vectors: DataFrame, width: int, classes: int, seed: int, maxIter: int = 20, maxDepth: int = 5, **params) -> BoostedTrees:
    return boosting.fit(vectors, width, classes, maxIter, maxDepth, **params)


# learners by name; the boosting libraries are not among them
LEARNERS: dict[str, Callable] = {
    "random_forest": _forest,
    "gradient_boosting": _boosted,
}


class Classifier:
    """A fitted learner with the feature columns it expects, in order."""

    def __init__(self, model: Model | BoostedTrees, columns: list[str], learner: str, classes: int):
        self.model, self.columns, self.learner, self.classes = model, columns, learner, classes

    def predict(self, rows: DataFrame) -> DataFrame:
        """Rows plus ``prediction`` and ``probs`` (one probability per class)."""
        others = [c for c in rows.columns if c not in self.columns]
        model_columns(rows, self.columns)  # raises when one is missing
        out = self.score(_assemble(rows, self.columns, self.learner))
        return out.select(*map(quoted, others), "prediction", "probs")

    def score(self, vectors: DataFrame) -> DataFrame:
        """Rows with ``features`` plus ``prediction`` and ``probs``."""
        if isinstance(self.model, BoostedTrees):
            out = vectors.withColumn("probs", self.model.probabilities(F.col("features")))
            best = F.array_position("probs", F.array_max("probs")) - 1
            return out.withColumn("prediction", best.cast("int"))
        out = self.model.transform(vectors)
        found = {"prediction": F.col("prediction").cast("int"), "probs": vector_to_array("probability")}
        return out.withColumns(found).drop("rawPrediction", "probability")

    def predict_frames(self, rows: DataFrame, frames: DataFrame) -> DataFrame:
        """Class and confidence for every row of ``frames``; frames without a row get -1 and 0."""
        found = self.predict(rows).select(*FRAME, "probs")
        zeros = F.array_repeat(F.lit(0.0), self.classes)
        spread = frames.select(*FRAME).join(found, FRAME, "left")
        filled = spread.withColumn("probs", F.coalesce("probs", zeros))
        return evaluate.derive_predictions(filled).withColumnRenamed("confidence", "prob")

    def importance(self, limit: int = 20) -> list[tuple[str, float]]:
        """Features by importance (2 decimals), highest first."""
        boosted = isinstance(self.model, BoostedTrees)
        weights = self.model.importance() if boosted else self.model.featureImportances.toArray()
        ranked = sorted(
            zip(self.columns, (round(float(w), 2) for w in weights)), key=lambda p: p[1], reverse=True
        )
        return ranked[:limit]


def _assemble(rows: DataFrame, columns: Sequence[str], learner: str) -> DataFrame:
    """The other columns plus ``features``: a vector, or an array with gaps for boosted trees."""
    ready = clean(rows, columns, learner)
    others = [c for c in rows.columns if c not in set(columns)]
    if learner == "gradient_boosting":
        return ready.select(*map(quoted, others), F.array(*map(quoted, columns)).cast("array<double>").alias("features"))
    short = {c: f"f{i}" for i, c in enumerate(columns)}  # the assembler resolves plain names only
    renamed = ready.selectExpr(*[f"`{c}`" for c in others], *[f"`{c}` AS {n}" for c, n in short.items()])
    return VectorAssembler(inputCols=list(short.values()), outputCol="features").transform(renamed).drop(*short.values())


def _training_vectors(rows: DataFrame, columns: Sequence[str], key: Sequence[str], learner: str, symmetric: bool) -> DataFrame:
    """Stored rows of ``key``, ``image`` (a mirror image), label and features, computed once."""
    if learner not in LEARNERS:
        raise ValueError(f"unknown learner {learner!r}, have {sorted(LEARNERS)}")
    if symmetric:
        rows = augment_symmetric(rows, columns, mark="image")
    else:
        rows = rows.withColumn("image", F.lit(False))
    label = F.col("label").cast("double").alias("label")
    path = scratch_folder(rows.sparkSession, "training-vectors")
    _assemble(rows, columns, learner).select(*key, "image", label, "features").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _fit(vectors: DataFrame, columns: list[str], key: Sequence[str], learner: str, balanced: bool, seed: int, params: dict) -> Classifier:
    if balanced:
        vectors = balance(vectors, [*key, "image"], "label", seed)
    vectors = vectors.select("features", "label")
    seen = vectors.agg(F.countDistinct("label").alias("n"), F.max("label").alias("top")).first()
    if seen["n"] < 2:
        raise ValueError(f"training needs at least 2 classes, found {seen['n']}")
    classes = int(seen["top"]) + 1
    model = LEARNERS[learner](vectors, len(columns), classes, seed, **params)
    return Classifier(model, columns, learner, classes)


def train(
    rows: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = FRAME,
    learner: str = "random_forest",
    symmetric: bool = False,
    balanced: bool = False,
    seed: int = TRAINING_SEED,
    **params,
) -> Classifier:
    """Fit on ``label`` (0, 1, …): mirror images first, then balancing, then the learner."""
    columns, key = list(columns), [k for k in key if k in rows.columns]
    vectors = _training_vectors(rows, columns, key, learner, symmetric)
    return _fit(vectors, columns, key, learner, balanced, seed, params)


def cross_validate(
    rows: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = FRAME,
    k: float = 1,
    excluded: DataFrame | None = None,
    threshold: int = LABEL_THRESHOLD,
    min_test_classes: int | None = None,
    learner: str = "random_forest",
    symmetric: bool = False,
    balanced: bool = False,
    seed: int = TRAINING_SEED,
    **params,
) -> DataFrame:
    """Leave-one-group-out: one result row per fold.

    ``rows`` has ``group_id``, ``label``, the key and the features. Its vectors are written once with their
    group, whatever the number of folds; folds read them, ``FOLDS_AT_ONCE`` beside each other. The driver holds
    the fold list and the count table (at most folds x classes²), which is scored once for all folds.
    """
    spark, columns = rows.sparkSession, list(columns)
    key = [c for c in key if c in rows.columns and c != "group_id"]
    vectors = _training_vectors(rows, columns, ["group_id", *key], learner, symmetric)
    own = vectors.filter(~F.col("image"))  # mirror images are learnt from, never counted or tested
    validity = crossval.split_validity(crossval.label_group_counts(own), excluded, threshold, min_test_classes)
    draw = F.xxhash64(F.lit(seed), "group_id")  # the order that folds are drawn in
    valid = [r["group_id"] for r in validity.filter("valid").orderBy(draw, "group_id").select("group_id").collect()]
    groups = valid[: crossval.resolve_splits(k, len(valid))]

    def run(numbered: tuple[int, int]) -> tuple[list[tuple], list[str]]:
        fold, group = numbered
        learnt = vectors.filter(F.col("group_id") != group)
        if excluded is not None:
            learnt = learnt.join(excluded.select("group_id"), "group_id", "left_anti")
        model = _fit(learnt, columns, key, learner, balanced, seed, params)
        counts = evaluate.confusion(model.score(own.filter(F.col("group_id") == group))).collect()
        table = [(fold, int(group), int(r["truth"]), r["predicted"], r["n"]) for r in counts]
        return table, [name for name, _ in model.importance(10)]

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(run), enumerate(groups, 1)))
    by = ["fold", "test_group"]
    counts = spark.createDataFrame(
        [row for table, _ in found for row in table], "fold int, test_group int, truth int, predicted int, n long"
    ).coalesce(1)
    features = spark.createDataFrame([(i, top) for i, (_, top) in enumerate(found, 1)], "fold int, top_features array<string>")
    scores = evaluate.averaged_scores(counts, by).join(evaluate.accuracy(counts, by), by)
    scores = scores.join(counts.groupBy("fold").agg(F.sum("n").alias("test_rows")), "fold").join(features, "fold")
    return scores.select(
        *by, "accuracy", "precision_macro", "recall_macro", "f1_macro", "test_rows", "top_features"
    ).orderBy("fold")
