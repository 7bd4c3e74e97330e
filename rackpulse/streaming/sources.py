"""File streams of samples, dumps and points.

Each reader takes a folder that collectors add files to. A message bus needs no
further code: its value column takes the place of the text column here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.functions.parse import WORKLOADS, keyed_json, sample_file_fields
from rackpulse.session import prepare
from rackpulse.sources.readings import bmc_readings, with_util_flag


def sample_stream(
    spark: SparkSession, folder: str, workloads: tuple[str, ...] = WORKLOADS, files_per_batch: int = 1000
) -> DataFrame:
    """Host and BMC samples of timestamp-keyed JSON files as they arrive."""
    text = prepare(spark).readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    named = text.select(
        sample_file_fields(F.col("_metadata.file_name"), workloads).alias("f"), "value"
    ).where("f IS NOT NULL")
    rows = named.select("f.*", F.explode(keyed_json("value")).alias("ts", "readings"))
    return rows.withColumn("ts", F.try_to_timestamp("ts")).select(*schemas.SAMPLE_RAW.fieldNames())


def host_sample_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Host samples with their utilisation flag."""
    return with_util_flag(sample_stream(spark, folder).where("kind = 'host'"))


def bmc_dump_streams(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sampler readings of JSON lines with host, product, ts, dcmi_text and sensor_text, and the rows of unknown products."""
    schema = "host string, product string, ts timestamp, dcmi_text string, sensor_text string"
    known, rejects = bmc_readings(spark.readStream.schema(schema).json(folder))
    return known.select("host", "ts", "window_secs", "readings"), rejects


def bmc_dump_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The readings alone; ``bmc_dump_streams`` gives the rejects beside them."""
    return bmc_dump_streams(spark, folder)[0]


def point_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.POINT).parquet(folder)
