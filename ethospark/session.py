"""Session helper for tests, the bench and interactive work."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tested with.

    On a cluster the session comes from outside; the operators only rely on AQE
    (on by default) and on ``spark.checkpoint.dir`` for the iterative ones.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ethospark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ETHOSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        # call sites of every column expression: helpful while debugging, slow for wide tables
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a folder of our own.

    The fallback is for local sessions, where driver and executors share a disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ethospark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, for intermediate tables."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
