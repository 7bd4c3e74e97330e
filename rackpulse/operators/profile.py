"""Distribution tables: power by load bin and by prediction outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.status import not_negative
from rackpulse.operators.ranking import exact_medians
from rackpulse.session import materialise

# Upper ends of the five load bins, in percent.
BIN_ENDS = (20, 40, 60, 80, 100)


def load_bin(load: str = "load"):
    """Bin 0 holds everything up to 20 %, the next ones are open below; above 100 there is none."""
    v = F.col(load)
    bins = F.when(v <= BIN_ENDS[0], 0)
    for i, end in enumerate(BIN_ENDS[1:], start=1):
        bins = bins.when(v <= end, i)
    return bins


def analysable(samples: DataFrame) -> DataFrame:
    """Samples fit for the profile: load, power, flag and inlet read and not negative."""
    load = F.coalesce("cpuload_total", F.try_element_at("extra", F.lit("cpuload")))
    return samples.withColumn("load", load).where(
        (F.col("load") >= 0) & (F.col("power") >= 0) & (F.col("util") >= 0)
        & (F.col("inlet_temp") >= 0) & not_negative("cpu_power")
    )


def load_bin_profile(df: DataFrame, load: str, metrics: list[str]) -> DataFrame:
    """Count, range, median and deviation of each metric in each load bin, empty bins included."""
    spark = df.sparkSession
    binned = df.select(load_bin(load).alias("bin"), *[F.col(m).cast("double").alias(m) for m in metrics])
    values = binned.where("bin IS NOT NULL").unpivot(["bin"], metrics, "metric", "value")
    # Written once: the three figures below all start from the distinct values.
    counts = materialise(
        values.where("value IS NOT NULL").groupBy("metric", "bin", "value").agg(F.count("*").alias("n")), "bin-counts"
    )
    key = ["metric", "bin"]
    basic = counts.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("_mean"),
    )
    # Bins times metrics bounds this table, so it may be broadcast.
    off = F.col("value") - F.col("_mean")
    spread = counts.join(F.broadcast(basic.select(*key, "_mean")), key).groupBy(*key).agg(
        F.sqrt(F.try_divide(F.sum(off * off * F.col("n")), F.sum("n") - 1)).alias("stddev")
    )
    grid = spark.createDataFrame(
        [(m, b) for m in metrics for b in range(len(BIN_ENDS))], "metric string, bin int"
    )
    return (
        grid.join(basic.drop("_mean"), key, "left")
        .join(exact_medians(counts, key), key, "left").join(spread, key, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def outcome_buckets(df: DataFrame, actual: str, predicted: str, value: str, width: float) -> DataFrame:
    """Histogram of a reading for every pair of actual and predicted class."""
    return df.groupBy(
        F.col(actual).alias("actual"), F.col(predicted).alias("predicted"),
        F.floor(F.col(value) / width).cast("bigint").alias("bucket"),
    ).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
