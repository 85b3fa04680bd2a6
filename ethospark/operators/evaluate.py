"""Scores of predicted against true classes, all from the (truth, prediction) count table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Count per (truth, prediction)."""
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions, in all or per ``by``."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return table.groupBy(*by).agg((F.sum(hit) / F.sum("n")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class (and ``by``); 0 where undefined.

    Classes are those that occur in truth or prediction.
    """
    n = F.col("n")
    sides = table.select(
        *by, F.explode(F.array(
            F.struct(F.col("truth").alias("cls"), n.alias("t"), F.lit(0).cast("bigint").alias("p"),
                     F.when(F.col("truth") == F.col("predicted"), n).otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("t"), n.alias("p"),
                     F.lit(0).cast("bigint").alias("hit")),
        )).alias("s")
    ).select(*by, "s.*")
    sums = sides.groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("t", "p", "hit")])
    precision, recall = _ratio(F.col("hit"), F.col("p")), _ratio(F.col("hit"), F.col("t"))
    f1 = _ratio(2 * F.col("hit"), F.col("t") + F.col("p"))
    return sums.select(
        *by, "cls", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.col("t").alias("support"),
    )


def averaged_scores(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro (mean over classes) and micro (pooled) precision, recall and F1, in all or per ``by``."""
    names = ("precision", "recall", "f1")
    macro = class_scores(table, by).groupBy(*by).agg(*[F.avg(c).alias(f"{c}_macro") for c in names])
    # one prediction per row: pooled precision, recall and F1 are all the accuracy
    micro = accuracy(table, by).select(*by, *[F.col("accuracy").alias(f"{c}_micro") for c in names])
    if by:
        return macro.join(micro, list(by))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731 (both sides are a single row)
    return one(macro).join(one(micro), "_one").drop("_one")


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population standard deviation per metric over the folds, finite values only."""
    finite = {
        m: F.when(~F.isnan(m) & (F.abs(F.col(m)) != float("inf")), F.col(m)) for m in metrics
    }
    return folds.agg(
        F.count(F.lit(1)).alias("iterations"),
        *[F.avg(c).alias(f"{m}_mean") for m, c in finite.items()],
        *[F.stddev_pop(c).alias(f"{m}_std") for m, c in finite.items()],
    )


def derive_predictions(rows: DataFrame, probabilities: str = "probs") -> DataFrame:
    """Class (first of the largest probabilities) and confidence; confidence 0 means class -1."""
    p = F.col(probabilities)
    best = F.array_max(p)
    cls = F.when(best == 0, -1).otherwise(F.array_position(p, best) - 1)
    return rows.withColumns({"cls": cls.cast("int"), "confidence": best})


