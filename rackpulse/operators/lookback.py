"""Latest measures and one-day look-backs on the long measure table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.skew import keyed_join
from rackpulse.session import materialise

# Metric names of the measure table.
LOGIN, LOAD, POWER, UP = "login_count", "load_avg", "Pwr Consumption", "up"
INLET, EXHAUST = "Inlet Temp", "Exhaust Temp"

DAY = "INTERVAL 1 DAY"


def latest_measures(measures: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Newest value of each metric per host, of equal times the larger; a login count needs two measures."""
    chosen = measures if metrics is None else measures.where(F.col("metric").isin(*metrics))
    return (
        chosen.groupBy("host", "metric")
        .agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"), F.count("*").alias("n"))
        .where((F.col("metric") != LOGIN) | (F.col("n") >= 2))
    )


def anchors(measures: DataFrame) -> DataFrame:
    """Per host with two or more login counts: the last one, its time, and the newest
    load and power measures, which the look-backs leave out."""
    login, load, power = (F.col("metric") == m for m in (LOGIN, LOAD, POWER))
    return (
        measures.where(F.col("metric").isin(LOGIN, LOAD, POWER))
        .groupBy("host")
        .agg(
            F.count_if(login).alias("n_login"),
            F.max_by("value", F.when(login, F.struct("ts", "value"))).alias("login_count"),
            F.max(F.when(login, F.col("ts"))).alias("anchor"),
            F.max(F.when(load, F.col("ts"))).alias("newest_load"),
            F.max(F.when(power, F.col("ts"))).alias("newest_power"),
        )
        .where("n_login >= 2")
        .drop("n_login")
    )


def lookbacks(measures: DataFrame) -> DataFrame:
    """Login count, looked-back load and mean power of each host's last day.

    The day is open at both ends and the newest measure of a series stays out.
    Load: the most recent positive value, else 0 if one is zero, else unknown.
    Power: the mean of the positive readings.
    """
    # One row per host, written once: the joins below then know its true size.
    starts = materialise(anchors(measures), "anchors")
    # No host looks back further than a day before the first anchor; older files are not read.
    oldest, newest = starts.agg(F.min("anchor")).scalar(), starts.agg(F.max("anchor")).scalar()
    day = measures.where(
        F.col("metric").isin(LOAD, POWER) & (F.col("ts") > oldest - F.expr(DAY)) & (F.col("ts") < newest)
    ).select("host", "metric", "ts", "value")
    # An anchored host has few rows; spreading it keeps one chatty host off one task.
    joined = keyed_join(day, starts, ["host"]).where(
        (F.col("ts") < F.col("anchor")) & (F.col("ts") > F.col("anchor") - F.expr(DAY))
    )
    load = (F.col("metric") == LOAD) & (F.col("ts") < F.col("newest_load"))
    power = (F.col("metric") == POWER) & (F.col("ts") < F.col("newest_power"))
    found = joined.groupBy("host").agg(
        F.max_by("value", F.when(load & (F.col("value") > 0), F.struct("ts", "value"))).alias("last_load"),
        F.max(F.when(load & (F.col("value") == 0), 0.0)).alias("zero_load"),
        F.avg(F.when(power & (F.col("value") > 0), F.col("value"))).alias("mean_power"),
    )
    return starts.join(found, "host", "left").select(
        "host", "anchor", "login_count",
        F.coalesce("last_load", "zero_load", F.lit(-1.0)).alias("load_avg"), "mean_power",
    )
