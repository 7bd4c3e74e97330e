"""Collector and sampler text turned into readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions import parse
from rackpulse.functions.status import ERROR, UNKNOWN, util_flag
from rackpulse.operators.inventory import bmc_access, inband_access
from rackpulse.operators.series import reading
from rackpulse.session import prepare
from rackpulse.sources.dimensions import bare_oid, sensor_profiles, ups_oids


def collector_readings(machines: DataFrame, bmc_fields: list[str]) -> DataFrame:
    """Readings of one poll: codes where a machine cannot be asked, parsed text elsewhere.

    Expects the text columns ``last_text``, ``uptime_text``, ``dcmi_text`` and ``sdr_text``.
    """
    inband, bmc = inband_access(), bmc_access(bmc_fields)
    temperature = lambda sensors: F.coalesce(
        bmc.cast("double"), parse.sdr_temperature(F.coalesce("sdr_text", F.lit("")), sensors)
    )
    return machines.select(
        "*",
        F.coalesce(inband, parse.login_count("last_text")).alias("login_count"),
        F.coalesce(inband.cast("double"), parse.load_average("uptime_text")).alias("load_avg"),
        F.coalesce(bmc.cast("double"), parse.dcmi_instant_power("dcmi_text")).alias("pwr_consumption"),
        temperature(parse.INLET_SENSORS).alias("inlet_temp"),
        temperature(parse.EXHAUST_SENSORS).alias("exhaust_temp"),
    )


def dump_summary(dumps: DataFrame, reachable: str = "reachable") -> DataFrame:
    """Result code (0 taken, -1 skipped, -2 failed) and line count of each dump."""
    code = F.when(~F.col(reachable), UNKNOWN).when(parse.is_blank("text"), ERROR).otherwise(0)
    return dumps.withColumn("result", code).withColumn(
        "n_lines", F.when(F.col("result") == 0, F.size(parse.text_lines("text"))).otherwise(0)
    )


def bmc_readings(dumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sampler readings by the sensor profile of each product, and rows of unknown products.

    Expects ``product``, ``dcmi_text`` and ``sensor_text``.
    """
    profiles = sensor_profiles(prepare(dumps.sparkSession))
    joined = dumps.join(profiles, "product", "left")
    rejects = joined.where("family IS NULL").select(*dumps.columns)
    known = joined.where("family IS NOT NULL")
    power = F.create_map(F.lit("power"), parse.dcmi_average_power("dcmi_text"))
    sensors = F.when(
        parse.is_blank("sensor_text"),
        F.when(F.size("roles") > 0, F.create_map(F.lit("power"), F.lit(float(ERROR))))
        .otherwise(F.create_map().cast("map<string,double>")),
    ).otherwise(parse.sensor_readings("sensor_text", "roles"))
    return known.withColumn("readings", F.map_concat(power, sensors)).drop("roles"), rejects


def with_util_flag(samples: DataFrame) -> DataFrame:
    """Host samples with the utilisation flag derived from their CPU load."""
    prepare(samples.sparkSession)
    load = reading("readings", "cpuload_total").try_cast("double")
    flag = F.create_map(F.lit("util"), util_flag(load).cast("string"))
    return samples.withColumn("readings", F.map_concat("readings", flag))


def open_bmc_samples(texts: DataFrame, text: str = "text") -> DataFrame:
    """Readings of an open controller: JSON objects in a row; blank text gives no rows."""
    prepare(texts.sparkSession)
    keys = [c for c in texts.columns if c != text]
    rows = texts.where(~F.trim(text).isin("", "\n")).select(
        *keys, F.explode(parse.keyed_json(text)).alias("key", "readings")
    )
    return rows


def ups_points(values: DataFrame) -> DataFrame:
    """Points of UPS readings; currents arrive in tenths. Unknown object ids are left out.

    Expects ``ups``, ``oid``, ``time`` and ``raw``.
    """
    oids = ups_oids(values.sparkSession)
    number = F.col("raw").cast("double")
    return (
        values.withColumn("oid", bare_oid("oid")).join(oids, "oid")
        .select(
            F.col("type").alias("measurement"),
            F.create_map(F.lit("ups"), F.col("ups"), F.lit("io"), F.col("io"), F.lit("phase"), F.col("phase"))
            .alias("tags"),
            F.col("time").cast("timestamp").alias("time"),
            F.when(F.col("type") == "current", number / 10).otherwise(number).alias("value"),
        )
    )
