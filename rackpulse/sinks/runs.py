"""Tables written in runs: a run that is repeated replaces itself, a run that fails shows nothing.

A run has a key (a poll's time, a night's date). Each attempt to write it goes to a folder of its own, and when all its files
are there a commit row names the attempt. Readers take the last committed attempt of every run, so they see a run whole or not
at all, rows of a failed or repeated attempt are never read, and a write never touches files that a reader may have open.
Commit rows are a small table beside the data; joined on the partition columns, they prune the folders that are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.session import rebalanced

RUN, ATTEMPT = "run", "attempt"
COMMIT = "run string, attempt string, rows bigint, number bigint, note string"


def _commits(path: str) -> str:
    """Beside the data, under a name that file scans of the table pass over."""
    return f"{path.rstrip('/')}/_commits"


def has_runs(spark: SparkSession, path: str) -> bool:
    """Whether a table at the path was written in runs."""
    return _exists(spark, _commits(path))


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema(COMMIT).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def write_run(df: DataFrame, path: str, run: str, partitions: list[str] | None = None, note: str | None = None) -> int:
    """Write a run and commit it; returns its rows. An error before the end leaves the last committed attempt in force.

    A run without rows is committed too, so a repetition that finds nothing replaces what was there. The note is part of the
    commit, for what a reader has to know of the run.
    """
    spark, attempt, partitions = df.sparkSession, uuid.uuid4().hex, partitions or []
    marked = df.withColumns({RUN: F.lit(run), ATTEMPT: F.lit(attempt)})
    ordered = rebalanced(marked, *partitions) if partitions else marked
    ordered.write.mode("append").partitionBy(RUN, ATTEMPT, *partitions).parquet(path)
    written = read_attempt(spark, path, df.schema, run, attempt).count()
    commit(spark, path, run, attempt, written, note)
    return written


def commit(spark: SparkSession, path: str, run: str, attempt: str, rows: int, note: str | None = None) -> None:
    """Put an attempt in force. The row is one file, which the writer makes visible as a whole."""
    known = commits(spark, path).where(F.col(RUN) == run).agg(F.max("number")).first()[0] if has_runs(spark, path) else None
    row = spark.createDataFrame([(run, attempt, rows, (known or 0) + 1, note)], COMMIT)
    row.coalesce(1).write.mode("append").json(_commits(path))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Every commit ever made; the one with the highest number is in force for its run."""
    return spark.read.schema(COMMIT).json(_commits(path))


def in_force(spark: SparkSession, path: str) -> DataFrame:
    """Run, attempt, rows and note of the commits in force."""
    newest = Window.partitionBy(RUN).orderBy(F.desc("number"), F.desc(ATTEMPT))
    return commits(spark, path).withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(RUN, ATTEMPT, "rows", "note")


def read_runs(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all committed runs, with their run. ``schema``: columns of the rows, those of the partitions included."""
    if not has_runs(spark, path):
        return spark.createDataFrame([], schema).withColumn(RUN, F.lit(None).cast("string"))
    rows = spark.read.schema(_marked(spark, schema)).parquet(path)
    return rows.join(in_force(spark, path).select(RUN, ATTEMPT), [RUN, ATTEMPT], "left_semi").drop(ATTEMPT)


def read_attempt(spark: SparkSession, path: str, schema, run: str, attempt: str) -> DataFrame:
    """Rows of one attempt, whatever has been committed since."""
    rows = spark.read.schema(_marked(spark, schema)).parquet(path)
    return rows.where((F.col(RUN) == run) & (F.col(ATTEMPT) == attempt)).drop(RUN, ATTEMPT)


def _marked(spark: SparkSession, schema):
    return spark.createDataFrame([], schema).withColumns({RUN: F.lit(""), ATTEMPT: F.lit("")}).schema


def replaced(spark: SparkSession, path: str, schema) -> DataFrame:
    """Run and attempt of written folders that are not in force, for expiry: repeated, failed or still being written."""
    written = spark.read.schema(_marked(spark, schema)).parquet(path).select(RUN, ATTEMPT).distinct()
    return written.join(in_force(spark, path).select(RUN, ATTEMPT), [RUN, ATTEMPT], "left_anti")
