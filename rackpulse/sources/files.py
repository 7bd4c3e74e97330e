"""Scans of the files a fleet installation writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.functions.parse import WORKLOADS, host_bucket, keyed_json, sample_file_fields
from rackpulse.operators.skew import last_wins
from rackpulse.session import prepare
from rackpulse.sinks import runs

# The fields of a roster entry that are taken over.
ROSTER_FIELDS = ("hostname", "ip_address", "user", "power_state", "power_user", "power_driver", "power_address")


def machines(spark: SparkSession, path: str) -> DataFrame:
    """Machine documents, one JSON object or list per file."""
    return spark.read.schema(schemas.MACHINE_RAW).json(path, multiLine=True)


def curated_machines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MACHINE_CURATED).parquet(path)


def host_list(spark: SparkSession, path: str) -> DataFrame:
    """Hosts with their place in the list; also used for chosen subsets and skip lists.

    A file holds one JSON list of names, or a row per host as ``sinks.tables.host_list`` writes it. Anything else
    is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value")).where("value != ''")
    strict = {"mode": "FAILFAST"}
    is_list = F.startswith("value", F.lit("["))
    lists = text.where(is_list).select(
        F.posexplode(F.from_json("value", "array<string>", strict)).alias("position", "hostname")
    )
    lines = text.where(~is_list).select(F.explode(F.split("value", "\n")).alias("line")).where("trim(line) != ''")
    rows = lines.select(F.from_json("line", "position int, hostname string", strict).alias("r")).select("r.*")
    return lists.unionByName(rows)


def _host_of_file(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix}$", 1)


def power_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Power controller fields from ``<host>-power_parameters.json``, without the password."""
    text = spark.read.option("pathGlobFilter", "*-power_parameters.json").text(path, wholetext=True)
    fields = F.from_json("value", "map<string,string>")
    names = ("power_user", "power_driver", "power_address")
    return text.select(_host_of_file(r"-power_parameters\.json").alias("hostname"), fields.alias("f")).select(
        "hostname", *[F.try_element_at("f", F.lit(n)).alias(n) for n in names]
    )


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Unmanaged machines from YAML lists; an empty list gives no rows.

    Every file is read; of several entries of a host the last by file name and place wins.
    """
    try:
        import yaml
    except ImportError as error:  # pragma: no cover - depends on the installation
        raise RuntimeError("reading a YAML roster needs PyYAML") from error

    def parsed(batches):
        for files in batches:
            rows = [
                (name, place, *(None if e.get(n) is None else str(e[n]) for n in ROSTER_FIELDS))
                for name, text in zip(files["file"], files["value"])
                for place, e in enumerate((yaml.safe_load(text) or {}).get("machines") or []) if e
            ]
            yield pd.DataFrame(rows, columns=["file", "place", *ROSTER_FIELDS])

    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = text.mapInPandas(parsed, "file string, place int, " + ", ".join(f"{n} string" for n in ROSTER_FIELDS))
    return last_wins(rows, ["hostname"], ["file", "place"]).drop("file", "place")


def roster_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Roster entries as rows, the last of each host; the password is not taken over."""
    rows = spark.createDataFrame(
        [(i, *(e.get(n) for n in ROSTER_FIELDS)) for i, e in enumerate(entries)],
        "place int, " + ", ".join(f"{n} string" for n in ROSTER_FIELDS),
    )
    return last_wins(rows, ["hostname"], ["place"]).drop("place")


def hardware_details(spark: SparkSession, path: str) -> DataFrame:
    """Hardware texts from ``<host>-details.xml``."""
    text = spark.read.option("pathGlobFilter", "*-details.xml").text(path, wholetext=True)
    return text.select(_host_of_file(r"-details\.xml").alias("hostname"), F.col("value").alias("details"))


def samples(
    spark: SparkSession, path: str, workloads: tuple[str, ...] = WORKLOADS
) -> DataFrame:
    """Raw samples: file name fields and the timestamp-keyed readings as rows."""
    text = prepare(spark).read.option("pathGlobFilter", "*_*_*-*_data.json").text(path, wholetext=True)
    named = text.select(
        sample_file_fields(F.col("_metadata.file_name"), workloads).alias("f"), "value"
    ).where("f IS NOT NULL")
    rows = named.select("f.*", F.explode(keyed_json("value")).alias("ts", "readings"))
    return rows.withColumn("ts", F.try_to_timestamp("ts")).select(*schemas.SAMPLE_RAW.fieldNames())


def curated_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SAMPLE_CURATED).parquet(path)


def encoded_samples(spark: SparkSession, path: str, hosts: list[str] | None = None) -> DataFrame:
    """Encoded data set written by ``sinks.tables.encoded``; a host list prunes its buckets."""
    df = spark.read.parquet(path)
    if hosts:
        buckets = [host_bucket(F.lit(h)) for h in hosts]
        df = df.where(F.col("host_bucket").isin(*buckets) & F.col("host").isin(*hosts))
    return df.drop("host_bucket")


def encoded_csv(spark: SparkSession, path: str, features: list[str], hosts: list[str]) -> DataFrame:
    """Data sets kept as one feature file and one label file per host, joined on host and time."""
    def read(kind: str, columns: str) -> DataFrame:
        files = [f"{path.rstrip('/')}/{h}-{kind}.csv" for h in hosts]
        df = spark.read.schema(columns).csv(files, header=True, enforceSchema=False)
        return df.withColumn("host", _host_of_file(rf"-{kind}\.csv"))

    x = read("X", "time string, " + ", ".join(f"`{f}` double" for f in features))
    y = read("y", "time string, util int, load double")
    return x.join(y, ["host", "time"])


def text_dumps(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Collector dumps named ``<host>-ipmitool-<kind>.txt``."""
    suffix = f"-ipmitool-{kind}.txt"
    text = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    return text.select(
        _host_of_file(suffix.replace(".", r"\.")).alias("host"), F.col("value").alias("text")
    )


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table written in runs, or one that is only appended to."""
    if runs.has_runs(spark, path):
        return runs.read_runs(spark, path, schema).drop(runs.RUN)
    return spark.read.schema(schema).parquet(path)


def measures(spark: SparkSession, path: str) -> DataFrame:
    """Measure table; a filter on the metric prunes partitions."""
    return _stored(spark, path, schemas.MEASURE)


def points(spark: SparkSession, path: str) -> DataFrame:
    """Point table; filters on measurement and date prune partitions."""
    return _stored(spark, path, schemas.POINT_STORED)


def alerts(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, schemas.ALERT)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Raw samples as stored by day and hour."""
    return _stored(spark, path, schemas.SEGMENT)


def users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USERS).json(path, multiLine=True)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DICTIONARY).parquet(path)


def benchmark_result(spark: SparkSession, path: str) -> DataFrame:
    """Host samples of a benchmark run kept as one timestamp-keyed JSON text per host.

    Host, run and workload come from the file name (``<run>_<sequence>-<host>-<workload>-<type>-<host>_data.json``); they are
    null for a file named otherwise.
    """
    text = prepare(spark).read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    named = text.select(
        F.col("_metadata.file_name").alias("file"), sample_file_fields(F.col("_metadata.file_name")).alias("f"), "value"
    )
    rows = named.select(
        "file", "f.run_ts", "f.host", "f.workload", F.explode(keyed_json("value")).alias("ts", "readings")
    )
    return rows.withColumn("ts", F.try_to_timestamp("ts"))
