"""File sources and sinks: tables written by the library's writers and read back by its readers, and files as collectors leave them.

Inputs are derived from the given tables; each query writes them below the shared scratch folder, reads them as a user would and
returns what came back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.catalog import features, fleet, inventory, series
from rackpulse.catalog import tables as t
from rackpulse.catalog.fleet import BASE_URL, UNDER_UTILISED
from rackpulse.catalog.inventory import STATIC_FEATURES
from rackpulse.catalog.tables import MACHINES, MEASURES, POLLED, SAMPLES, fixed, sql_fixed
from rackpulse.functions.parse import micros
from rackpulse.functions.status import up_code
from rackpulse.models import estimators, experiment
from rackpulse.operators import evaluate
from rackpulse.operators.series import reading
from rackpulse.plans import fleet_poll, utilisation
from rackpulse.session import scratch_path
from rackpulse.sinks import runs, tables
from rackpulse.sources import dimensions, files
from rackpulse.streaming import sinks as live
from rackpulse.streaming import sources as streams

FLEET_HOSTS = 25  # nations, as the hosts that leave files


def _named_files(rows: DataFrame, name: str) -> str:
    """Texts as files of their own names (columns ``name`` and ``text``), as collectors leave them; returns the folder."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    rows.select("name", "text").repartition("name").write.partitionBy("name").text(f"{folder}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(f"{folder}/files"))
    for part in system.globStatus(path(f"{folder}/parts/name=*/part-*")):
        file = part.getPath()
        system.rename(file, path(f"{folder}/files/{file.getParent().getName().removeprefix('name=')}"))
    return f"{folder}/files"


def _json_lists(rows: DataFrame, name: str, lists: int = 4) -> str:
    """Rows as files that hold one JSON list each."""
    folder = scratch_path(rows.sparkSession, name)
    dealt = rows.groupBy(F.pmod(F.xxhash64(*[c for c, k in rows.dtypes if k in ("string", "bigint")]), F.lit(lists)).alias("part"))
    dealt.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("text")).repartition("part").write.partitionBy("part").text(folder)
    return folder

# -- inventory files ------------------------------------------------------------------


def machine_files(spark, d):
    """Machine documents in JSON lists."""
    read = files.machines(spark, _json_lists(t.machines(spark, d), "machine-files"))
    return read.select(
        "hostname", "system_id", "owner", F.col("pool.name").alias("pool"), "status_name", "power_state", (F.size("tag_names") > 0).alias("is_virtual"),
        F.get("ip_addresses", F.lit(0)).alias("first_ip"), F.col("hardware_info.system_product").alias("product"),
    )


MACHINE_FILES = f"WITH {MACHINES} SELECT hostname, system_id, owner, pool, status_name, power_state, is_virtual, first_ip, product FROM mach"


def host_list_file(spark, d):
    """A host list written row by row and read back with its places."""
    path = scratch_path(spark, "hosts")
    tables.host_list(t.machines(spark, d).select("hostname", "position"), path)
    return files.host_list(spark, path)


def power_parameter_files(spark, d):
    """Controller fields of a file for each host, without its password."""
    rows = fleet._parameters(spark, d).where(F.col("hostname").cast("int") <= FLEET_HOSTS)
    text = F.to_json(F.struct("power_user", "power_pass", "power_driver", "power_address"))
    folder = _named_files(rows.select(F.concat("hostname", F.lit("-power_parameters.json")).alias("name"), text.alias("text")), "parameters")
    return files.power_parameters(spark, folder)


POWER_PARAMETERS = f"""
SELECT CAST(s_suppkey AS VARCHAR) AS hostname, 'admin' AS power_user, 'LAN_2_0' AS power_driver,
  CASE WHEN s_nationkey > 3 THEN '172.31.1.1' END AS power_address FROM supplier WHERE s_suppkey <= {FLEET_HOSTS}"""


def user_files(spark, d):
    return files.users(spark, _json_lists(t.users(spark, d), "user-files")).select("username", "email")


USER_FILES = "SELECT 'user' || n_nationkey AS username, lower(n_name) || '@example.org' AS email FROM nation"


def temperature_limit_file(spark, d):
    """Safe ranges of products from one JSON object."""
    rows = t.read(spark, d, "nation").select(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("P"), F.col("n_nationkey").cast("string")), F.struct(F.col("n_regionkey").cast("int").alias("min"), (F.col("n_nationkey") + 20).cast("int").alias("max"))
    ))).alias("limits"))
    folder = _named_files(rows.select(F.lit("limits.json").alias("name"), F.to_json("limits").alias("text")), "limits")
    return dimensions.read_product_temperatures(spark, folder)


TEMPERATURE_LIMITS = """
SELECT 'P' || n_nationkey AS product, CAST(n_regionkey AS INT) AS "min", CAST(n_nationkey + 20 AS INT) AS "max" FROM nation"""


def roster_files(spark, d):
    """Unmanaged machines of YAML lists, one file a region; of two entries of a host the last wins."""
    rows = t.read(spark, d, "nation").withColumn("host", F.concat(F.lit("rack-"), (F.col("n_nationkey") % 20).cast("string")))
    entry = F.concat(F.lit("  - hostname: "), "host", F.lit("\n    ip_address: 10.1.0."), F.col("n_nationkey").cast("string"), F.lit("\n    power_pass: secret\n"))
    texts = rows.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", entry.alias("e")))).alias("es")).select(
        F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit(".yml")).alias("name"),
        F.concat(F.lit("machines:\n"), F.array_join(F.transform("es", lambda e: e["e"]), "")).alias("text"))
    return files.roster(spark, _named_files(texts, "roster")).select("hostname", "ip_address", "user")


ROSTER = """
SELECT hostname, ip_address, CAST(NULL AS VARCHAR) AS "user" FROM (
  SELECT 'rack-' || (n_nationkey % 20) AS hostname, '10.1.0.' || n_nationkey AS ip_address,
    row_number() OVER (PARTITION BY n_nationkey % 20 ORDER BY n_regionkey DESC, n_nationkey DESC) AS rn FROM nation) z WHERE rn = 1"""

# -- raw series -----------------------------------------------------------------------


def _fleet_events(spark, d) -> DataFrame:
    """Events as readings of few hosts: clicks and purchases by the BMC. Of one host and time the highest number stays."""
    rows = t.read(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.concat(F.lit("rack-"), (F.col("user_id") % FLEET_HOSTS).cast("string")).alias("host"),
        F.when(F.col("event_type").isin("click", "purchase"), "bmc").otherwise("host").alias("kind"),
    )
    return rows.groupBy("host", "kind", "ts").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


SQL_FLEET = f"""
fe AS (SELECT 'rack-' || (user_id % {FLEET_HOSTS}) AS host, CASE WHEN event_type IN ('click', 'purchase') THEN 'bmc' ELSE 'host' END AS kind, ts,
  arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL)"""


def _sample_files(spark, d, wtype: Column) -> str:
    """A file for each host and kind, with readings by time."""
    readings = F.when(F.col("kind") == "bmc", F.create_map(F.lit("power"), "value")).otherwise(F.create_map(F.lit("cpuload_total"), "value"))
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), readings)
    texts = _fleet_events(spark, d).withColumn("wtype", wtype).groupBy("host", "kind", "wtype").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))
    name = F.concat(F.lit("20240101_000000_000-"), "host", F.lit("-real-"), "wtype", F.lit("-"), "kind", F.lit("_data.json"))
    return _named_files(texts.withColumn("name", name), "samples")


def sample_files(spark, d):
    """Raw samples of timestamp-keyed files, with the fields of their names."""
    rows = files.samples(spark, _sample_files(spark, d, F.lit("production")))
    value = F.coalesce(reading("readings", "power"), reading("readings", "cpuload_total")).cast("double")
    return rows.select("run_ts", "seq", "host", "workload", "wtype", "kind", micros("ts").alias("ts_us"), fixed(value).alias("value"))


SAMPLE_FILES = f"""
WITH {SQL_FLEET}
SELECT '20240101_000000' AS run_ts, 0 AS seq, host, 'real' AS workload, 'production' AS wtype, kind, epoch_us(ts) AS ts_us, {sql_fixed('value')} AS value FROM fe"""


def benchmark_files(spark, d):
    """Results of benchmark runs: the host's series alone, run and workload from the name."""
    folder = _sample_files(spark, d, F.lit("benchmark"))
    rows = files.benchmark_result(spark, folder).where(F.endswith("file", F.lit("host_data.json")))
    return rows.groupBy("run_ts", "host", "workload").agg(
        F.count("*").alias("n"), micros(F.max("ts")).alias("last_us"), fixed(F.sum(reading("readings", "cpuload_total").cast("double")), 2).alias("load"))


BENCHMARK_FILES = f"""
WITH {SQL_FLEET}
SELECT '20240101_000000' AS run_ts, host, 'real' AS workload, count(*) AS n, epoch_us(max(ts)) AS last_us, {sql_fixed('sum(value)', 2)} AS load
FROM fe WHERE kind = 'host' GROUP BY host"""


def text_dump_files(spark, d):
    """Sensor lists of a file for each host."""
    lines = _fleet_events(spark, d).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("event_id", F.concat_ws(",", F.lit("Sensor"), F.col("event_id").cast("string"), F.lit("ok")).alias("l")))).alias("ls"))
    texts = lines.select(F.concat("host", F.lit("-ipmitool-sdr.txt")).alias("name"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n").alias("text"))
    read = files.text_dumps(spark, _named_files(texts, "dumps"), "sdr")
    return read.select("host", F.posexplode(F.split(F.trim(F.translate("text", "\n", " ")), " ")).alias("place", "line"))


TEXT_DUMPS = f"""
WITH {SQL_FLEET}
SELECT host, CAST(row_number() OVER (PARTITION BY host ORDER BY event_id) - 1 AS INT) AS place, 'Sensor,' || event_id || ',ok' AS line FROM fe"""

# -- tables written and read back ------------------------------------------------------


def curated_sample_table(spark, d):
    """Curated samples through their table, partitioned by day."""
    path = scratch_path(spark, "curated")
    tables.curated_samples(series.curate_samples(series._raw_samples(spark, d), 2 * series.HOUR, 5 * series.SECOND), path)
    rows = files.curated_samples(spark, path)
    return rows.select(
        "host", "run_ts", micros("bmc_ts").alias("bmc_us"), micros("host_ts").alias("host_us"),
        *[fixed(c).alias(c) for c in ("power", "power_px", "inlet_temp", "cpuload_total", "loadavg", "util")],
        F.col("extra")["shared"].alias("shared"), F.col("extra")["Fan1"].alias("fan1"), F.size("extra").alias("n_extra"),
    )


def encoded_table(spark, d):
    """The encoded set through its table; a host list reads its buckets only."""
    path = scratch_path(spark, "encoded")
    tables.encoded(features._encoded(spark, d), path)
    hosts = [str(i) for i in range(1, 8)]
    return files.encoded_samples(spark, path, hosts).groupBy("host", "util", "load").agg(
        F.count("*").alias("n"), fixed(F.sum("overall_power"), 3).alias("overall_power"), micros(F.max("time")).alias("last_us"))


ENCODED_TABLE = f"""
WITH {features.ENCODED}
SELECT host, util, load, count(*) AS n, {sql_fixed('sum(overall_power)', 3)} AS overall_power, epoch_us(max(bmc_ts)) AS last_us
FROM enc WHERE CAST(host AS INT) BETWEEN 1 AND 7 GROUP BY 1, 2, 3"""


def dictionary_table(spark, d):
    path = scratch_path(spark, "dictionary")
    tables.dictionary(inventory.label_dictionary(spark, d), path)
    return files.dictionary(spark, path)


def static_feature_file(spark, d):
    """Hardware features as CSV; capacities with two decimals, counts and codes as they are."""
    path = scratch_path(spark, "static")
    tables.static_features(inventory.static_features(spark, d), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("hostname", *[F.col(c).cast("double").alias(c) for c in ("memory_capacity", "disk_capacity", "processor_cores", "system_product", "disk_D1")])


STATIC_FILE = f"""
SELECT hostname, round(memory_capacity, 2) AS memory_capacity, round(disk_capacity, 2) AS disk_capacity, CAST(processor_cores AS DOUBLE) AS processor_cores,
  CAST(system_product AS DOUBLE) AS system_product, CAST("disk_D1" AS DOUBLE) AS "disk_D1" FROM ({STATIC_FEATURES.strip()}) z"""


def training_export(spark, d):
    """Training rows as CSV, read back typed."""
    path = scratch_path(spark, "export")
    rows = features._encoded(spark, d).select("host", "overall_power", "inlet_temp", "util", "load")
    tables.csv_export(rows, path)
    read = spark.read.schema(rows.schema).option("header", True).csv(path)
    return read.groupBy("host", "load").agg(F.count("*").alias("n"), fixed(F.sum("overall_power"), 3).alias("overall_power"), fixed(F.sum("inlet_temp"), 3).alias("inlet_temp"))


TRAINING_EXPORT = f"""
WITH {features.ENCODED}
SELECT host, load, count(*) AS n, {sql_fixed('sum(overall_power)', 3)} AS overall_power, {sql_fixed('sum(inlet_temp)', 3)} AS inlet_temp FROM enc GROUP BY 1, 2"""


def saved_model_scored(spark, d):
    """A model fitted on even suppliers, saved, loaded, and used on the others: predictions written, read back and measured."""
    samples = t.samples(spark, d).select("host", F.col("power_px").alias("overall_power"), F.col("cpuload_total").alias("load"))
    even = F.col("host").cast("int") % 2 == 0
    path, task = scratch_path(spark, "model"), experiment.Task("reg", "lir", ("overall_power",), lower=10.0, upper=90.0)
    fitted = estimators.fit(samples.where(even), "reg", "lir", ["overall_power"], "load")
    tables.model(fitted, path, "lir")
    scored, _ = experiment.score_saved(estimators.load(f"{path}/model", ["overall_power"], "load"), samples.where(~even), task)
    tables.csv_export(scored, f"{path}/predictions")
    read = spark.read.schema(scored.schema).option("header", True).csv(f"{path}/predictions")
    row = evaluate.regression_metrics(read, "actual_cpu_load", "detected_cpu_load", 1)
    return row.select("n", *[fixed(c, 5).alias(c) for c in ("rmse", "mae", "r2", "adjr2")])


SAVED_MODEL = f"""
WITH {SAMPLES},
fit AS (SELECT regr_slope(cpuload_total, power_px) AS b, regr_intercept(cpuload_total, power_px) AS a FROM smp WHERE CAST(host AS INT) % 2 = 0),
e AS (SELECT cpuload_total AS y, a + b * power_px AS p FROM smp, fit WHERE CAST(host AS INT) % 2 = 1 AND cpuload_total > 10 AND cpuload_total <= 90),
z AS (SELECT count(*) AS n, sum((y - p) * (y - p)) AS sse, avg(abs(y - p)) AS mae, var_pop(y) * count(*) AS sst FROM e)
SELECT n, {sql_fixed('sqrt(sse / n)', 5)} AS rmse, {sql_fixed('mae', 5)} AS mae, {sql_fixed('1 - sse / sst', 5)} AS r2,
  {sql_fixed('1 - (sse / sst) * (n - 1) / (n - 2)', 5)} AS adjr2 FROM z"""

# -- runs that are repeated ------------------------------------------------------------


def stored_poll(spark, d):
    """A poll stored, stored again with other readings, and once more: what points and measures hold is the last one."""
    polled = t.polled(spark, d).select(
        "hostname", "power_state", F.lit("2024-02-01 00:00:00").cast("timestamp").alias("time"), "load_avg", F.col("power").alias("pwr_consumption"),
        F.lit(-1).alias("login_count"), up_code("power_state").alias("up_status"), F.lit(-1.0).alias("inlet_temp"), F.lit(-1.0).alias("exhaust_temp"),
    )
    points, measures = scratch_path(spark, "points"), scratch_path(spark, "measures")
    for poll in (polled, polled.withColumn("load_avg", F.col("load_avg") + 7).limit(10), polled):
        fleet_poll.store_poll(poll, points, measures)
    host = files.points(spark, points).where(F.col("tags")["host"].isNotNull())
    stored = host.select(F.lit("points").alias("store"), F.col("tags")["host"].alias("host"), F.col("measurement").alias("metric"), micros("time").alias("time_us"), "value")
    rows = files.measures(spark, measures).select(F.lit("measures").alias("store"), "host", "metric", micros("ts").alias("time_us"), "value")
    return stored.unionByName(rows).where(F.col("metric").isin("load_avg", "pwr_consumption", "Pwr Consumption", "up", "up_status")).withColumn("value", fixed("value"))


STORED_POLL = f"""
WITH {POLLED}, v AS (
  SELECT hostname AS host, 'load_avg' AS p, 'load_avg' AS q, load_avg AS v FROM polled UNION ALL SELECT hostname, 'pwr_consumption', 'Pwr Consumption', power FROM polled
  UNION ALL SELECT hostname, 'up_status', 'up', CAST(CASE power_state WHEN 'error' THEN -1 WHEN 'on' THEN 1 WHEN 'off' THEN 0 ELSE -2 END AS DOUBLE) FROM polled)
SELECT 'points' AS store, host, p AS metric, epoch_us(TIMESTAMP '2024-02-01 00:00:00') AS time_us, {sql_fixed('v')} AS value FROM v
UNION ALL SELECT 'measures', host, q, epoch_us(TIMESTAMP '2024-02-01 00:00:00'), {sql_fixed('v')} FROM v"""


def stored_measures(spark, d):
    """Measures stored by month, each month first with a part of its rows, then whole; one month more is never committed."""
    path = scratch_path(spark, "measure-runs")
    rows = t.measures(spark, d).withColumn("granularity", F.lit(300.0)).select("host", "metric", "ts", "granularity", "value")
    months = [r[0] for r in rows.select(F.date_format("ts", "yyyy-MM").alias("m")).distinct().orderBy("m").collect()]
    for month in months:
        of = rows.where(F.date_format("ts", "yyyy-MM") == month)
        tables.measures(of.where("value > 40"), path, month)
        tables.measures(of, path, month)
    # An attempt that ended before its commit.
    rows.limit(100).withColumns({runs.RUN: F.lit("2030-01"), runs.ATTEMPT: F.lit("lost")}).write.mode("append").partitionBy(runs.RUN, runs.ATTEMPT, "metric").parquet(path)
    return files.measures(spark, path).groupBy("host", "metric").agg(F.count("*").alias("n"), fixed(F.sum("value"), 3).alias("total"), micros(F.max("ts")).alias("last_us"))


STORED_MEASURES = f"""
WITH {MEASURES} SELECT host, metric, count(*) AS n, {sql_fixed('sum(value)', 3)} AS total, epoch_us(max(ts)) AS last_us FROM m GROUP BY 1, 2"""


def stored_segments(spark, d):
    """Raw samples stored by day and hour, the whole run twice."""
    path = scratch_path(spark, "segments")
    raw = series._raw_samples(spark, d)
    for _ in range(2):
        tables.raw_segments(raw, path, run="collector-1")
    rows = files.segments(spark, path)
    return rows.groupBy("host", "kind", F.date_format("date", "yyyy-MM-dd").alias("date"), "hour").agg(F.count("*").alias("n"))


STORED_SEGMENTS = """
SELECT CAST(user_id AS VARCHAR) AS host, CASE WHEN event_type IN ('click', 'purchase') THEN 'bmc' ELSE 'host' END AS kind,
  strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL"""


def stored_alerts(spark, d):
    """The nightly job run twice: every owner is told once."""
    path = scratch_path(spark, "nightly")
    for _ in range(2):
        utilisation.nightly_run(t.machines(spark, d), t.measures(spark, d), t.users(spark, d), BASE_URL, f"{path}/alerts", f"{path}/points")
    return files.alerts(spark, f"{path}/alerts").withColumn("links", F.array_join("links", " | "))

# -- streams over files ----------------------------------------------------------------


def stream_segments(spark, d):
    """Sample files as a stream into segments: by the hour, BMC series of other than production runs undivided."""
    wtype = F.when(F.col("host").isin("rack-1", "rack-2", "rack-3"), "benchmark").otherwise("production")
    path = scratch_path(spark, "live-segments")
    query = live.hourly_segments(streams.sample_stream(spark, _sample_files(spark, d, wtype)), f"{path}/data", f"{path}/state", "1 second")
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(f"{path}/data").groupBy("host", "kind", "wtype", F.date_format("date", "yyyy-MM-dd").alias("date"), "hour").agg(F.count("*").alias("n"))


STREAM_SEGMENTS = f"""
WITH {SQL_FLEET}, w AS (SELECT *, CASE WHEN host IN ('rack-1', 'rack-2', 'rack-3') THEN 'benchmark' ELSE 'production' END AS wtype FROM fe)
SELECT host, kind, wtype, strftime(ts, '%Y-%m-%d') AS date, CAST(CASE WHEN kind = 'bmc' AND wtype <> 'production' THEN -1 ELSE hour(ts) END AS INT) AS hour,
  count(*) AS n FROM w GROUP BY ALL"""


def stream_alerts(spark, d):
    """Temperature alerts of a batch of measures; the batch that is repeated replaces its alerts."""
    path = scratch_path(spark, "live-alerts")
    check = live.temperature_alerts(t.machines(spark, d), t.users(spark, d), dimensions.product_temperatures(spark), BASE_URL, path)
    for _ in range(2):
        check(t.measures(spark, d), 3)
    read = spark.read.parquet(path)
    return read.select("owner", "email", "subject", "host", "reason", F.array_join("links", " | ").alias("links"))


QUERIES = {
    "machine_files": (machine_files, MACHINE_FILES),
    "host_list_file": (host_list_file, f"WITH {MACHINES} SELECT hostname, CAST(position AS INT) AS position FROM mach"),
    "power_parameter_files": (power_parameter_files, POWER_PARAMETERS),
    "user_files": (user_files, USER_FILES),
    "temperature_limit_file": (temperature_limit_file, TEMPERATURE_LIMITS),
    "roster_files": (roster_files, ROSTER),
    "sample_files": (sample_files, SAMPLE_FILES),
    "benchmark_files": (benchmark_files, BENCHMARK_FILES),
    "text_dump_files": (text_dump_files, TEXT_DUMPS),
    "curated_sample_table": (curated_sample_table, series.CURATED),
    "encoded_table": (encoded_table, ENCODED_TABLE),
    "dictionary_table": (dictionary_table, inventory.LABEL_DICTIONARY),
    "static_feature_file": (static_feature_file, STATIC_FILE),
    "training_export": (training_export, TRAINING_EXPORT),
    "saved_model_scored": (saved_model_scored, SAVED_MODEL),
    "stored_poll": (stored_poll, STORED_POLL),
    "stored_measures": (stored_measures, STORED_MEASURES),
    "stored_segments": (stored_segments, STORED_SEGMENTS),
    "stored_alerts": (stored_alerts, UNDER_UTILISED),
    "stream_segments": (stream_segments, STREAM_SEGMENTS),
    "stream_alerts": (stream_alerts, fleet.UNSAFE_TEMP),
}
