"""Session settings every plan relies on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Naive timestamps are UTC everywhere.
    "spark.sql.session.timeZone": "UTC",
    # Readings merge with the right-hand map winning.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Larger generated methods are never compiled by the JVM; split code is faster
    # for the wide expressions of encoding and parsing.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session (all can change at run time)."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Where a session in one process keeps its tables if it names no folder.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may name none; its own tables then go when it
    ends. On a cluster a missing setting is an error, since executors could not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = f"{LOCAL_FOLDER}/rackpulse-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        _own_folders.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return LOCAL_FOLDER


_own_folders: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, grouped by application for later expiry."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/rackpulse-{application}/{name}-{uuid.uuid4().hex}"


def rebalanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows gathered by the columns for a partitioned write.

    Adaptive execution splits a value with much data over several tasks and joins
    small ones, so files keep a sensible size whatever the spread.
    """
    return df.hint("rebalance", *columns)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    Used where a result feeds several later jobs: the lineage ends at the written
    files, so a lost executor never forces the upstream work again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
