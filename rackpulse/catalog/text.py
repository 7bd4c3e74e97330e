"""Parsers of collector text, embedded JSON and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import fixed, sql_fixed
from rackpulse.functions import parse
from rackpulse.operators.series import reading
from rackpulse.sources.dimensions import PRODUCT_FAMILIES
from rackpulse.sources.readings import (
    bmc_readings, collector_readings, dump_summary, open_bmc_samples, with_util_flag,
)


def _s(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def _events(spark, d):
    """Events with their numeric property."""
    events = t.read(spark, d, "events")
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""

def _failed() -> Column:
    return F.col("event_type") == "error"



def _uptime() -> Column:
    line = F.concat(F.lit("10:00 up 3 days, 1 user, load average: 0.10, "), _s("value"), F.lit(", 0.01\n"))
    return F.when(_failed(), "").otherwise(line)


def _last() -> Column:
    session = F.concat(F.lit("bob pts/"), _s("k"), F.lit(" 10.0.0.9 Mon Jan 1\n"))
    return F.when(_failed(), "").otherwise(F.concat(
        F.repeat(session, F.col("k") % 5), F.lit("amy tty1 Mon Jan 1\nreboot system boot 5.4\n\nwtmp begins Mon\n")
    ))


def _dcmi() -> Column:
    head = F.concat(
        F.lit("Instantaneous power reading: "), _s("value"), F.lit(" Watts\nMinimum during sampling period: 1 Watts\n"
        "Maximum during sampling period: 9 Watts\nAverage power reading over sample period: "), _s("k"),
        F.lit(" Watts\nIPMI timestamp: now\nSampling period: 1 Seconds.\n"),
    )
    tail = F.when(F.col("event_type") == "signup", "").otherwise("Power reading state is: activated\n")
    return F.when(_failed(), "").otherwise(F.concat(head, tail))


def _sdr() -> Column:
    state = F.when(F.col("event_type") == "view", "ns").otherwise("ok")
    return F.when(_failed(), "").otherwise(F.concat(
        F.lit("Inlet Temp,"), _s("k"), F.lit(",degrees C,"), state, F.lit("\n01-Inlet Ambient,"), _s(F.col("k") + 1),
        F.lit(",degrees C,"), state, F.lit("\nOther,1,degrees C,ok\nTemp_Outlet,"), _s("value"), F.lit(",degrees C,ok\n"),
    ))


def uptime_parse(spark, d):
    return _events(spark, d).select("event_id", fixed(parse.load_average(_uptime())).alias("load_avg"))


def login_count_parse(spark, d):
    return _events(spark, d).select("event_id", parse.login_count(_last()).alias("login_count"))


def dcmi_parse(spark, d):
    return _events(spark, d).select(
        "event_id", fixed(parse.dcmi_instant_power(_dcmi())).alias("instant"),
        fixed(parse.dcmi_average_power(_dcmi())).alias("average"),
    )


DCMI = f"""
WITH {EVENTS}
SELECT event_id, {sql_fixed("CASE event_type WHEN 'error' THEN -2.0 WHEN 'signup' THEN -1.0 ELSE value END")} AS instant,
  {sql_fixed("CASE event_type WHEN 'error' THEN -2.0 ELSE k END")} AS average FROM ev"""


def sdr_parse(spark, d):
    return _events(spark, d).select(
        "event_id", fixed(parse.sdr_temperature(_sdr(), parse.INLET_SENSORS)).alias("inlet"),
        fixed(parse.sdr_temperature(_sdr(), parse.EXHAUST_SENSORS)).alias("exhaust"),
    )


SDR = f"""
WITH {EVENTS}
SELECT event_id, {sql_fixed("CASE WHEN event_type IN ('error', 'view') THEN -1.0 ELSE k + 1 END")} AS inlet,
  {sql_fixed("CASE WHEN event_type = 'error' THEN -1.0 ELSE value END")} AS exhaust FROM ev"""


def poll_readings(spark, d):
    """All readings of a poll, with codes for machines that are off or out of reach."""
    machines = _events(spark, d).select(
        "event_id", F.when(F.col("k") < 10, "off").when(F.col("k") < 20, "error").otherwise("on").alias("power_state"),
        F.when(F.col("k") < 80, "bot").alias("user"), F.when(F.col("k") < 90, "admin").alias("power_user"),
        _last().alias("last_text"), _uptime().alias("uptime_text"), _dcmi().alias("dcmi_text"), _sdr().alias("sdr_text"),
    )
    read = collector_readings(machines, ["power_user"])
    return read.select(
        "event_id", "login_count",
        *[fixed(c).alias(c) for c in ("load_avg", "pwr_consumption", "inlet_temp", "exhaust_temp")],
    )


_OOB = "WHEN k BETWEEN 10 AND 19 OR k >= 90 THEN -1.0"
POLL_READINGS = f"""
WITH {EVENTS}
SELECT event_id,
  CAST(CASE WHEN k < 10 THEN -3 WHEN k < 20 OR k >= 80 THEN -1 WHEN event_type = 'error' THEN -2
    ELSE k % 5 + 1 END AS INT) AS login_count,
  {sql_fixed("CASE WHEN k < 10 THEN -3.0 WHEN k < 20 OR k >= 80 THEN -1.0 WHEN event_type = 'error' THEN -2.0 ELSE value END")} AS load_avg,
  {sql_fixed(f"CASE {_OOB} WHEN event_type = 'error' THEN -2.0 WHEN event_type = 'signup' THEN -1.0 ELSE value END")} AS pwr_consumption,
  {sql_fixed(f"CASE {_OOB} WHEN event_type IN ('error', 'view') THEN -1.0 ELSE k + 1 END")} AS inlet_temp,
  {sql_fixed(f"CASE {_OOB} WHEN event_type = 'error' THEN -1.0 ELSE value END")} AS exhaust_temp
FROM ev"""


def dump_lines(spark, d):
    dumps = _events(spark, d).select(
        "event_id", (F.col("k") >= 20).alias("reachable"), _last().alias("text")
    )
    return dump_summary(dumps).select("event_id", "result", "n_lines")


DUMP_LINES = f"""
WITH {EVENTS}, r AS (
  SELECT event_id, k, CASE WHEN k < 20 THEN -1 WHEN event_type = 'error' THEN -2 ELSE 0 END AS result FROM ev)
SELECT event_id, result, CAST(CASE WHEN result = 0 THEN k % 5 + 4 ELSE 0 END AS INT) AS n_lines FROM r"""


def _profiled(spark, d):
    """Sensor dumps read by the profile of four products; an unknown product is rejected."""
    by_family = {family: product for product, family in PRODUCT_FAMILIES.items()}
    kind = F.col("event_type")
    product = (
        F.when(kind == "click", by_family["RX2540"]).when(kind == "view", by_family["PowerEdge"])
        .when(kind == "purchase", by_family["RX2530"]).when(kind == "signup", by_family["DGX"]).otherwise("unheard of")
    )
    text = F.concat(
        F.lit("Systemboard 1,"), _s("k"), F.lit("\nSystemboard 2,40\nInlet Temp,"), _s(F.col("k") + 1),
        F.lit("\nExhaust Temp,41\nTemp_Inlet_MB,"), _s(F.col("k") + 2), F.lit("\nCPU1 Power,"), _s("value"),
        F.lit("\nCPU2 Power,12.5\nFAN1 SYS,4000\nFan1,3000\nSystemboard Pwr,25\nPower_GPGPU0,7\nFan_SYS0_1,bad\n"),
    )
    dumps = _events(spark, d).select("event_id", product.alias("product"), _dcmi().alias("dcmi_text"), text.alias("sensor_text"))
    return bmc_readings(dumps)


def sensor_profiles(spark, d):
    known, _ = _profiled(spark, d)
    names = ("power", "inlet_temp", "exhaust_temp", "cpu_power", "systemboard_power")
    return known.select(
        "event_id", "family", *[fixed(reading("readings", c)).alias(c) for c in names],
        fixed(reading("readings", "FAN1 SYS")).alias("fan_sys"), fixed(reading("readings", "Fan1")).alias("fan"),
        fixed(reading("readings", "Power_GPGPU0")).alias("gpu_power"), F.size("readings").alias("n"),
    )


def sensor_profile_rejects(spark, d):
    """Dumps of products without a profile, as they came."""
    _, rejects = _profiled(spark, d)
    return rejects.select("event_id", "product", F.length("sensor_text").alias("n_chars"))


SENSOR_PROFILE_REJECTS = f"""
WITH {EVENTS}
SELECT event_id, 'unheard of' AS product, CAST(length(concat('Systemboard 1,', k, chr(10), 'Systemboard 2,40', chr(10), 'Inlet Temp,', k + 1, chr(10),
  'Exhaust Temp,41', chr(10), 'Temp_Inlet_MB,', k + 2, chr(10), 'CPU1 Power,', value, chr(10), 'CPU2 Power,12.5', chr(10), 'FAN1 SYS,4000', chr(10),
  'Fan1,3000', chr(10), 'Systemboard Pwr,25', chr(10), 'Power_GPGPU0,7', chr(10), 'Fan_SYS0_1,bad', chr(10))) AS INT) AS n_chars
FROM ev WHERE event_type = 'error'"""


SENSOR_PROFILES = f"""
WITH {EVENTS}
SELECT event_id,
  CASE event_type WHEN 'click' THEN 'RX2540' WHEN 'view' THEN 'PowerEdge' WHEN 'purchase' THEN 'RX2530' ELSE 'DGX' END AS family,
  {sql_fixed('k')} AS power,
  {sql_fixed("CASE event_type WHEN 'view' THEN k + 1 WHEN 'signup' THEN k + 2 ELSE k END")} AS inlet_temp,
  CASE event_type WHEN 'view' THEN 41.0::DOUBLE WHEN 'signup' THEN NULL ELSE 40.0::DOUBLE END AS exhaust_temp,
  {sql_fixed("CASE event_type WHEN 'click' THEN value + 12.5 END")} AS cpu_power,
  CASE event_type WHEN 'purchase' THEN 25.0::DOUBLE END AS systemboard_power,
  CASE WHEN event_type IN ('click', 'purchase') THEN 4000.0::DOUBLE END AS fan_sys,
  CASE event_type WHEN 'view' THEN 3000.0::DOUBLE END AS fan,
  CASE event_type WHEN 'signup' THEN 7.0::DOUBLE END AS gpu_power,
  CAST(CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 ELSE 3 END AS INT) AS n
FROM ev WHERE event_type <> 'error'"""


def series_json(spark, d):
    """Timestamp-keyed JSON to rows; array readings are kept as text and dropped as numbers."""
    text = F.concat(
        F.lit('{"'), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit('":{"power":'),
        _s("value"), F.lit(',"net_util":[1,2]},"2024-03-01 00:00:00":{"power":'), _s("k"), F.lit("}}"),
    )
    rows = _events(spark, d).select("event_id", F.explode(parse.keyed_json(text)).alias("ts", "readings"))
    numbers = rows.withColumn("numbers", parse.double_readings("readings"))
    return numbers.select(
        "event_id", parse.micros(F.try_to_timestamp("ts")).alias("ts_us"), fixed(reading("numbers", "power")).alias("power"),
        reading("readings", "net_util").alias("net_util"), F.size("numbers").alias("n"),
    )


SERIES_JSON = f"""
WITH {EVENTS}
SELECT event_id, epoch_us(ts) AS ts_us, {sql_fixed('value')} AS power, '[1,2]' AS net_util, CAST(1 AS INT) AS n FROM ev
UNION ALL SELECT event_id, epoch_us(TIMESTAMP '2024-03-01 00:00:00'), {sql_fixed('k')}, NULL, CAST(1 AS INT) FROM ev"""


def concat_json(spark, d):
    """JSON objects in a row; the last of two equal keys wins, blank text gives no rows."""
    objects = F.concat(
        F.lit('{"a":{"power":'), _s("value"), F.lit('}}{"b":{"power":1},"a":{"power":'), _s("k"), F.lit("}}"),
    )
    text = F.when(_failed(), "\n").otherwise(objects)
    rows = open_bmc_samples(_events(spark, d).select("event_id", text.alias("text")))
    return rows.select("event_id", "key", reading("readings", "power").cast("double").alias("power"))


CONCAT_JSON = f"""
WITH {EVENTS}
SELECT event_id, 'a' AS key, CAST(k AS DOUBLE) AS power FROM ev WHERE event_type <> 'error'
UNION ALL SELECT event_id, 'b', 1.0::DOUBLE FROM ev WHERE event_type <> 'error'"""


def file_names(spark, d):
    """Fields of sample file names; hosts hold hyphens, other names give none."""
    kind = F.when(F.col("event_type") == "click", "host").otherwise("bmc")
    name = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(_s("k"), 3, "0"),
        F.lit("-rack-"), _s("user_id"), F.lit("-real-production-"), kind, F.lit("_data.json"),
    )
    shaped = F.when(_failed(), "notes.json").otherwise(name)
    return _events(spark, d).select("event_id", parse.sample_file_fields(shaped).alias("f")).select(
        "event_id", "f.run_ts", "f.seq", "f.host", "f.workload", "f.wtype", "f.kind"
    )


_KNOWN = "event_type <> 'error'"
FILE_NAMES = f"""
WITH {EVENTS}
SELECT event_id, CASE WHEN {_KNOWN} THEN strftime(ts, '%Y%m%d_%H%M%S') END AS run_ts, CASE WHEN {_KNOWN} THEN k END AS seq,
  CASE WHEN {_KNOWN} THEN 'rack-' || user_id END AS host, CASE WHEN {_KNOWN} THEN 'real' END AS workload,
  CASE WHEN {_KNOWN} THEN 'production' END AS wtype,
  CASE WHEN {_KNOWN} THEN CASE event_type WHEN 'click' THEN 'host' ELSE 'bmc' END END AS kind FROM ev"""


def util_flags(spark, d):
    """Utilisation flag a sampler adds to each host sample: the sign of its load."""
    load = F.when(F.col("k") < 30, 0.0).when(F.col("k") < 50, -1.0).otherwise(F.col("value"))
    samples = _events(spark, d).select("event_id", F.create_map(F.lit("cpuload_total"), _s(load)).alias("readings"))
    return with_util_flag(samples).select("event_id", reading("readings", "util").cast("int").alias("util"))


UTIL_FLAGS = f"""
WITH {EVENTS}
SELECT event_id, CAST(CASE WHEN k < 30 THEN 0 WHEN k < 50 THEN -1 ELSE sign(value) END AS INT) AS util FROM ev"""

QUERIES = {
    "uptime_parse": (
        uptime_parse,
        f"""SELECT event_id, {sql_fixed("CASE event_type WHEN 'error' THEN -2.0 ELSE value END")} AS load_avg FROM events""",
    ),
    "login_count_parse": (
        login_count_parse,
        f"WITH {EVENTS} SELECT event_id, CAST(CASE event_type WHEN 'error' THEN -2 ELSE k % 5 + 1 END AS INT) AS login_count FROM ev",
    ),
    "dcmi_parse": (dcmi_parse, DCMI),
    "sdr_parse": (sdr_parse, SDR),
    "poll_readings": (poll_readings, POLL_READINGS),
    "dump_summary": (dump_lines, DUMP_LINES),
    "sensor_profile_readings": (sensor_profiles, SENSOR_PROFILES),
    "sensor_profile_rejects": (sensor_profile_rejects, SENSOR_PROFILE_REJECTS),
    "series_json_explode": (series_json, SERIES_JSON),
    "concat_json": (concat_json, CONCAT_JSON),
    "sample_file_names": (file_names, FILE_NAMES),
    "util_flags": (util_flags, UTIL_FLAGS),
}
