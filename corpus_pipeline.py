"""The corpus pipeline: raw documents → packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a stored table, for texts go to Python in small Arrow
batches, which holds for jobs that the stage itself runs; what a stage stored on its way is emptied when its own table is
written; all but the last return the columns of ``documents``. Rows that share an id stay or go together; rows with
a null id stay where a stage decides by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from ethospark.llm.common import forget, passing, small_batches, stored, table
from ethospark.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in no language the labelled ones teach."""
    profile = language_id.fit(docs)
    kept = language_id.predict(docs, profile).filter(~F.col("rejected"))
    return kept.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated runs of lines; a document that loses all its lines goes."""
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    sized = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", sized.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: five words, 0.8."""
    classes = jaccard_join.jaccard_components(docs, size=5, percent=80)
    gone = classes.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item or an edited copy of one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 1024: one row per piece."""
    return packing.pack(docs, tokenizer(), special=True)


def _stored(name: str, stage: Callable) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            with passing(spark) as spent:
                result = stage(spark, docs, sf_dir)
            result = stored(result, f"pipeline-{name}", tidy=True, codec="zstd")
            for made in spent:
                forget(made)
            return result

    return run_stage


STAGES = [
    (name, _stored(name, stage))
    for name, stage in (
        ("language_id", identify_language),
        ("line_dedup", dedup_lines),
        ("jaccard_join", dedup_documents),
        ("decontamination", drop_benchmark),
        ("packing", pack),
    )
]
ORACLE_SQL = None  # language models and alignments are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if before is not None:
            forget(before)
        before = docs
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
