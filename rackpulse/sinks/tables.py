"""Table sinks. Partition columns follow how the tables are read back."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.parse import host_bucket
from rackpulse.session import rebalanced
from rackpulse.sinks import runs

log = logging.getLogger(__name__)


def curated_machines(df: DataFrame, path: str, as_json: bool = False) -> None:
    writer = df.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)


def host_list(df: DataFrame, path: str, host: str = "hostname") -> None:
    """Distinct hosts, a JSON row each; ``sources.files.host_list`` reads them back, with the place where there is one."""
    place = F.min("position") if "position" in df.columns else F.lit(None)
    hosts = df.groupBy(F.col(host).alias("hostname")).agg(place.cast("int").alias("position"))
    hosts.write.mode("overwrite").json(path)


def dictionary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def static_features(df: DataFrame, path: str) -> None:
    """Hardware features as CSV with header; capacities keep two decimals."""
    two = lambda c: F.format_string("%3.2f", F.col(c).cast("double"))
    shaped = df.withColumns({c: two(c) for c in ("memory_capacity", "disk_capacity") if c in df.columns})
    shaped.write.mode("overwrite").option("header", True).csv(path)


def curated_samples(df: DataFrame, path: str) -> None:
    """Curated samples by day, ordered by host and time for pruning by row group."""
    dated = df.withColumn("date", F.to_date("bmc_ts"))
    ordered = rebalanced(dated, "date").sortWithinPartitions("date", "host", "bmc_ts")
    ordered.write.mode("overwrite").partitionBy("date").parquet(path)


def encoded(df: DataFrame, path: str) -> None:
    """Encoded data set, partitioned by a hash bucket of the host and ordered by host.

    A host list prunes buckets and then row groups; the number of folders does not
    grow with the fleet.
    """
    bucketed = df.withColumn("host_bucket", host_bucket("host"))
    ordered = rebalanced(bucketed, "host_bucket").sortWithinPartitions("host_bucket", "host")
    ordered.write.mode("overwrite").partitionBy("host_bucket").parquet(path)


def encoded_parts(df: DataFrame, path: str) -> None:
    """Features and labels as separate tables, for inspection."""
    labels = [c for c in ("util", "load") if c in df.columns]
    keys = [c for c in ("host", "time") if c in df.columns]
    df.drop(*labels).write.mode("overwrite").option("header", True).csv(f"{path}/sensors")
    df.select(*keys, *labels).write.mode("overwrite").option("header", True).csv(f"{path}/groundtruth")


def points(df: DataFrame, path: str, run: str | None = None) -> bool:
    """Points by measurement and day. A failed write is logged and told; the caller keeps the points.

    With a run, a repetition replaces the run's points (see ``runs``); without one, points are appended.
    """
    dated = df.withColumn("date", F.to_date("time"))
    try:
        if run is not None:
            runs.write_run(dated, path, run, ["measurement", "date"])
        else:
            rebalanced(dated, "measurement", "date").write.mode("append").partitionBy("measurement", "date").parquet(path)
        return True
    except Exception:  # noqa: BLE001 - the other stores of a poll still run; the caller raises afterwards
        log.exception("writing points to %s failed", path)
        return False


def measures(df: DataFrame, path: str, run: str | None = None) -> None:
    """Measures of resources by metric; a new resource or type needs no preparation. A repeated run replaces itself."""
    if run is not None:
        runs.write_run(df, path, run, ["metric"])
    else:
        rebalanced(df, "metric").write.mode("append").partitionBy("metric").parquet(path)


def measures_from_points(points_df: DataFrame, resource: Column, granularity: float) -> DataFrame:
    """Points as rows of the measure table."""
    return points_df.select(
        resource.alias("host"), F.col("measurement").alias("metric"), F.col("time").alias("ts"),
        F.lit(granularity).alias("granularity"), "value",
    )


def raw_segments(df: DataFrame, path: str, ts: str = "ts", run: str | None = None) -> None:
    """Raw samples by day and hour, the segment length of production runs. A repeated run replaces itself."""
    cut = df.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts))
    if run is not None:
        runs.write_run(cut, path, run, ["date", "hour"])
    else:
        rebalanced(cut, "date", "hour").write.mode("append").partitionBy("date", "hour").parquet(path)


def alerts(df: DataFrame, path: str, run: str | None = None) -> None:
    """Alert rows by reason. A repeated run replaces its alerts, so nobody is told twice."""
    if run is not None:
        runs.write_run(df, path, run, ["reason"])
    else:
        df.write.mode("append").partitionBy("reason").parquet(path)


def model(fitted, path: str, method: str) -> None:
    """A fitted model; a logistic one also leaves its coefficients as CSV, a row per class."""
    fitted.save(f"{path}/model")
    if method == "lor":
        csv_export(fitted.coefficients(SparkSession.active()), f"{path}/coefficients")


def csv_export(df: DataFrame, path: str) -> None:
    """Training, test or prediction rows as CSV with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def redacted(df: DataFrame, column: str = "power_pass") -> DataFrame:
    """Host dump with the password masked."""
    return df.withColumn(column, F.lit("xxxx"))
