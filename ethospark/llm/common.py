"""Small helpers of the operators: names, tables, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.session import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_inside: list[list[DataFrame]] = []  # what ``stored`` has made inside each open ``passing``


def stored(df: DataFrame, name: str, tidy: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here, work is done once.

    With ``tidy`` Spark removes the shuffle files of the write when it has ended. ``codec``: Parquet's, if not the session's."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true" if tidy else before)
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    made = spark.read.schema(df.schema).parquet(path)
    for tables in _inside[-1:]:
        tables.append(made)
    return made


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """The tables that ``stored`` makes inside, for the caller to ``forget``; their shuffle files go with each write."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    _inside.append([])
    try:
        yield _inside[-1]
    finally:
        _inside.pop()
        spark.conf.set(TIDY, before)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # Spark's 64 MB are held several times by every task


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand Arrow batches of about ``BATCH_BYTES`` to Python."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def forget(table: DataFrame) -> None:
    """Replaces a table of ``stored`` that is not needed any more by an empty one."""
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body).getItem(0)


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds
