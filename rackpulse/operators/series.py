"""Host and BMC series: validity rules, the time-tolerance join and curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rackpulse.functions.parse import double_readings, micros
from rackpulse.functions.status import all_of, not_negative
from rackpulse.operators.skew import last_wins
from rackpulse.schemas import SAMPLE_COLUMNS
from rackpulse.session import prepare

SECOND = 1_000_000
SLICE_SECONDS = 600


def tolerance_join(
    bmc: DataFrame, host: DataFrame, keys: list[str], tolerance_us: int = SECOND,
    drift_us: int = 0, tie: list[str] | None = None,
) -> DataFrame:
    """Pair every BMC row with the earliest host row less than the tolerance away.

    Both frames carry ``keys`` and a microsecond column ``t``; the result has the
    keys and the two rows as structs ``bmc_row`` and ``host_row``. Their times satisfy
    ``|bmc - drift - host| < tolerance`` strictly; ``tie`` orders host rows
    with equal time.

    The earliest such host row is the first one after ``bmc - drift - tolerance``,
    so one ordered pass finds it and no candidate pairs are built. Time is cut into
    slices so that a busy host spreads over many tasks; host rows near the start
    of a slice are also given to the slice before.
    """
    slice_us = max(2 * tolerance_us, SLICE_SECONDS * SECOND)
    reach = 2 * tolerance_us
    tie = tie or []
    left = bmc.select(
        *keys, (F.col("t") - drift_us - tolerance_us).alias("_t"), F.lit(0).alias("_side"),
        F.struct(*[c for c in bmc.columns if c not in keys]).alias("bmc_row"),
    )
    right = host.select(
        *keys, F.col("t").alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[c for c in host.columns if c not in keys]).alias("host_row"),
    )
    into = F.pmod(F.col("_t"), F.lit(slice_us))
    start = F.col("_t") - into
    left = left.withColumn("_slice", start)
    right = right.withColumn(
        "_slice", F.explode(F.when(into < reach, F.array(start - slice_us, start)).otherwise(F.array(start)))
    )
    # Newest first: the last host row seen is the earliest one still ahead. A BMC row
    # goes before host rows of its own time, which are exactly the tolerance away.
    backwards = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(F.desc("_t"), F.asc("_side"), *[F.desc(f"host_row.{c}") for c in tie])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = left.unionByName(right, allowMissingColumns=True)
    return (
        both.withColumn("_next", F.last("host_row", ignorenulls=True).over(backwards))
        .where((F.col("_side") == 0) & (F.col("_next.t") < F.col("_t") + reach))
        .select(*keys, "bmc_row", F.col("_next").alias("host_row"))
    )


def reading(readings: Column | str, name: str) -> Column:
    """One numeric reading of a map, null when absent."""
    source = F.col(readings) if isinstance(readings, str) else readings
    return F.try_element_at(source, F.lit(name))


def valid_host_sample(readings: Column | str) -> Column:
    """Host sample without negative load average, utilisation flag or supply readings.

    The two supply readings count only when both are present.
    """
    p0, p1 = reading(readings, "power_p0"), reading(readings, "power_p1")
    return all_of([
        not_negative(reading(readings, "loadavg")),
        not_negative(reading(readings, "util")),
        F.coalesce((p0 >= 0) & (p1 >= 0), F.lit(True)),
    ])


def valid_bmc_sample(readings: Column | str) -> Column:
    return all_of([not_negative(reading(readings, n)) for n in ("power", "inlet_temp")])


def with_supply_power(readings: Column) -> Column:
    """Adds ``power_px``, the sum of both supplies, where both are read."""
    p0, p1 = reading(readings, "power_p0"), reading(readings, "power_p1")
    both = p0.isNotNull() & p1.isNotNull()
    return F.when(both, F.map_concat(readings, F.create_map(F.lit("power_px"), p0 + p1))).otherwise(readings)


def curate_samples(
    samples: DataFrame, tolerance_us: int = SECOND, drift_us: int = 0
) -> DataFrame:
    """Curated samples of raw host and BMC samples.

    Samples pair inside one run (run stamp, sequence, host, workload, type). Host
    readings replace BMC readings of the same name. When several runs yield the
    same host and BMC time the highest run stamp and sequence wins.
    """
    prepare(samples.sparkSession)
    keys = ["run_ts", "seq", "host", "workload", "wtype"]
    typed = samples.select(
        *keys, "kind", micros("ts").alias("t"), double_readings("readings").alias("readings")
    )
    bmc = typed.where((F.col("kind") == "bmc") & valid_bmc_sample("readings")).drop("kind")
    host = typed.where((F.col("kind") == "host") & valid_host_sample("readings")).drop("kind")
    joined = tolerance_join(bmc, host, keys, tolerance_us, drift_us)
    merged = joined.withColumn(
        "readings", F.map_concat("bmc_row.readings", with_supply_power(F.col("host_row.readings")))
    ).withColumn("bmc_ts", F.timestamp_micros("bmc_row.t")).withColumn("host_ts", F.timestamp_micros("host_row.t"))
    unique = last_wins(merged, ["host", "wtype", "bmc_ts"], ["run_ts", "seq", "workload"])
    return spread_readings(unique)


def spread_readings(df: DataFrame) -> DataFrame:
    """Known readings as columns, the remaining ones as the ``extra`` map."""
    known = F.array(*[F.lit(c) for c in SAMPLE_COLUMNS])
    return df.select(
        "host", "wtype", "run_ts", "seq", "bmc_ts", "host_ts",
        *[reading("readings", c).cast("double").alias(c) for c in SAMPLE_COLUMNS],
        F.map_filter("readings", lambda k, _: ~F.array_contains(known, k)).alias("extra"),
    )


def aligned_samples(df: DataFrame, keys: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Last value of each window boundary a sampler aligns to; of equal times the larger value."""
    start = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")["start"]
    return df.groupBy(*keys, start.alias("window_start")).agg(
        F.max_by(value, F.struct(ts, value)).alias(value), F.count("*").alias("n")
    )


def sensors_with_truth(sensors: DataFrame, truth: DataFrame) -> DataFrame:
    """Sensor rows joined to their labels on host and time."""
    return sensors.join(truth, ["host", "time"])
