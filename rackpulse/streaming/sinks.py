"""Streaming sinks. Every batch writes its own folder, so a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rackpulse.plans import temperature
from rackpulse.session import scratch_path


def run_available(df: DataFrame, name: str, output: str) -> DataFrame:
    """Process all files present into a table and return it; used for scheduled runs."""
    spark = df.sparkSession
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", output)
        .option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(output)


def hourly_segments(samples: DataFrame, path: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """Raw samples by day and hour. BMC samples are cut by the hour for production runs;
    of other runs they go into one undivided segment."""
    whole = (F.col("kind") == "bmc") & (F.col("wtype") != "production")
    cut = samples.withColumn("date", F.to_date("ts")).withColumn(
        "hour", F.when(whole, F.lit(-1)).otherwise(F.hour("ts"))
    )
    return (
        cut.writeStream.format("parquet").partitionBy("date", "hour").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def batch_writer(path: str, partitions: list[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that writes each batch below its own number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={number}")

    return write


def point_sink(points: DataFrame, path: str, checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    dated = points.withColumn("date", F.to_date("time"))
    return (
        dated.writeStream.foreachBatch(batch_writer(path, ["measurement", "date"]))
        .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    )


def temperature_alerts(
    machines: DataFrame, users: DataFrame, limits: DataFrame, base_url: str, path: str
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that checks the temperatures of each batch of measures."""
    write = batch_writer(path, ["reason"])

    def check(batch: DataFrame, number: int) -> None:
        unsafe = temperature.unsafe_machines(machines, batch, limits)
        write(temperature.alerts(unsafe, users, base_url), number)

    return check
