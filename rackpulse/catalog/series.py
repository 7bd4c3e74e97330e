"""The tolerance join, curated samples, last-wins selection and poll windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import MEASURES, fixed, sql_fixed, sql_status
from rackpulse.functions.parse import micros
from rackpulse.functions.status import STATUSES
from rackpulse.operators.series import SECOND, aligned_samples, curate_samples, tolerance_join
from rackpulse.operators.skew import last_wins
from rackpulse.streaming.rollups import poll_status

HOUR = 3600 * SECOND


def _sides(spark, d, *columns):
    """Views and purchases as BMC rows, all other events as host rows."""
    events = t.read(spark, d, "events").withColumn("t", micros("ts")).withColumn("bmc", F.col("event_type").isin("view", "purchase"))
    side = lambda bmc: events.where(F.col("bmc") == bmc).select(*columns, "event_id", "t")
    return side(True), side(False)


def _pairs(spark, d, keys, tolerance, drift):
    bmc, host = _sides(spark, d, *keys)
    joined = tolerance_join(bmc, host, keys, tolerance, drift, tie=["event_id"])
    return joined.select(F.col("bmc_row.event_id").alias("bmc_id"), F.col("host_row.event_id").alias("host_id"))


def _sql_pairs(match: str, tolerance: int, drift: int) -> str:
    return f"""
SELECT a.event_id AS bmc_id, arg_min(b.event_id, row(b.ts, b.event_id)) AS host_id
FROM events a JOIN events b ON {match} abs(epoch_us(a.ts) - {drift} - epoch_us(b.ts)) < {tolerance}
WHERE a.event_type IN ('view', 'purchase') AND b.event_type NOT IN ('view', 'purchase') GROUP BY 1"""


def tolerance_join_fleet(spark, d):
    return _pairs(spark, d, [], 60 * SECOND, 0)


def tolerance_join_drift(spark, d):
    return _pairs(spark, d, [], 60 * SECOND, 5 * SECOND)


def tolerance_join_host(spark, d):
    return _pairs(spark, d, ["user_id"], 6 * HOUR, 5 * SECOND)


def _raw_samples(spark, d):
    """Events as raw samples of daily runs: clicks and purchases by the BMC, the others by the host."""
    k = F.get_json_object("props", "$.k")
    number = lambda c: c.cast("string")
    coded = F.when(F.col("event_id") % 20 == 0, -2.0).otherwise(F.col("value"))
    bmc = F.create_map(
        F.lit("power"), number(coded), F.lit("inlet_temp"), k, F.lit("shared"), F.lit("1"), F.lit("Fan1"), F.lit("3000"),
    )
    host = F.create_map(
        F.lit("cpuload_total"), number(F.col("value")), F.lit("loadavg"), number(coded / 10), F.lit("util"), F.lit("1"),
        F.lit("power_p0"), k, F.lit("power_p1"), number(k.cast("int") + 1), F.lit("shared"), F.lit("2"),
        F.lit("net_util"), F.lit("[1,2]"),
    )
    by_bmc = F.col("event_type").isin("click", "purchase")
    return t.read(spark, d, "events").select(
        F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd").alias("run_ts"), F.lit(0).alias("seq"),
        F.col("user_id").cast("string").alias("host"), F.lit("real").alias("workload"), F.lit("production").alias("wtype"),
        F.when(by_bmc, "bmc").otherwise("host").alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(by_bmc, bmc).otherwise(host).alias("readings"),
    )


def curated_samples(spark, d):
    rows = curate_samples(_raw_samples(spark, d), 2 * HOUR, 5 * SECOND)
    return rows.select(
        "host", "run_ts", micros("bmc_ts").alias("bmc_us"), micros("host_ts").alias("host_us"),
        *[fixed(c).alias(c) for c in ("power", "power_px", "inlet_temp", "cpuload_total", "loadavg", "util")],
        F.col("extra")["shared"].alias("shared"), F.col("extra")["Fan1"].alias("fan1"), F.size("extra").alias("n_extra"),
    )


CURATED = f"""
WITH e AS (
  SELECT *, strftime(ts, '%Y%m%d') AS run_ts, CAST(json_extract(props, '$.k') AS INT) AS k,
    CASE WHEN event_id % 20 = 0 THEN -2.0::DOUBLE ELSE value END AS coded, event_type IN ('click', 'purchase') AS is_bmc
  FROM events),
p AS (
  SELECT a.event_id AS a_id, arg_min(b.event_id, b.ts) AS b_id
  FROM e a JOIN e b ON a.user_id = b.user_id AND a.run_ts = b.run_ts AND a.is_bmc AND NOT b.is_bmc
    AND a.coded >= 0 AND b.coded >= 0 AND abs(epoch_us(a.ts) - {5 * SECOND} - epoch_us(b.ts)) < {2 * HOUR}
  GROUP BY 1)
SELECT CAST(a.user_id AS VARCHAR) AS host, a.run_ts, epoch_us(a.ts) AS bmc_us, epoch_us(b.ts) AS host_us,
  {sql_fixed('a.value')} AS power, {sql_fixed('b.k * 2 + 1')} AS power_px, {sql_fixed('a.k')} AS inlet_temp,
  {sql_fixed('b.value')} AS cpuload_total, {sql_fixed('b.value / 10')} AS loadavg, 1.0::DOUBLE AS util,
  2.0::DOUBLE AS shared, 3000.0::DOUBLE AS fan1, CAST(2 AS INT) AS n_extra
FROM p JOIN e a ON a.event_id = p.a_id JOIN e b ON b.event_id = p.b_id"""


def dedupe_last_wins(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = t.read(spark, d, "lineitem").select("l_suppkey", "l_shipdate", *order)
    kept = last_wins(rows, ["l_suppkey", "l_shipdate"], order)
    return kept.select("l_suppkey", micros("l_shipdate").alias("ship_us"), "l_orderkey", "l_linenumber")


DEDUPE = """
SELECT l_suppkey, epoch_us(l_shipdate) AS ship_us, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem) x
WHERE rn = 1"""


def aligned(spark, d):
    rows = aligned_samples(t.measures(spark, d), ["metric"], "ts", "value", 300)
    return rows.select("metric", micros("window_start").alias("window_us"), fixed("value").alias("value"), "n")


ALIGNED = f"""
WITH {MEASURES}
SELECT metric, epoch_us(time_bucket(INTERVAL '5 minutes', ts)) AS window_us, {sql_fixed('arg_max(value, ts)')} AS value,
  count(*) AS n FROM m GROUP BY 1, 2"""


def points(spark, d):
    """Load and power measures as points."""
    name = F.when(F.col("metric") == "load_avg", "load_avg").otherwise("pwr_consumption")
    return t.measures(spark, d).where(F.col("metric").isin("load_avg", "Pwr Consumption")).select(
        name.alias("measurement"), F.create_map(F.lit("host"), F.col("host")).alias("tags"), F.col("ts").alias("time"), "value"
    )


def shaped_rollup(rolled):
    return rolled.select(
        micros("poll_start").alias("poll_us"), *[f"n_{s}" for s in STATUSES],
        *[fixed(f"power_{s}", 3).alias(f"power_{s}") for s in STATUSES],
    )


def poll_rollup(spark, d):
    return shaped_rollup(poll_status(points(spark, d), "6 hours"))


_COLUMNS = ", ".join(
    [f"count(*) FILTER ({sql_status('load')} = '{s}') AS n_{s}" for s in STATUSES]
    + [sql_fixed(f"coalesce(sum(power) FILTER ({sql_status('load')} = '{s}'), 0)", 3) + f" AS power_{s}" for s in STATUSES]
)
POLL_ROLLUP = f"""
WITH {MEASURES}, h AS (
  SELECT time_bucket(INTERVAL '6 hours', ts) AS poll, host, arg_max(value, ts) FILTER (metric = 'load_avg') AS load,
    arg_max(value, ts) FILTER (metric = 'Pwr Consumption') AS power
  FROM m WHERE metric IN ('load_avg', 'Pwr Consumption') GROUP BY 1, 2)
SELECT epoch_us(poll) AS poll_us, {_COLUMNS} FROM h GROUP BY poll"""

SQL_PAIRS_PER_HOST = _sql_pairs("a.user_id = b.user_id AND", 6 * HOUR, 5 * SECOND)

QUERIES = {
    "tolerance_join": (tolerance_join_fleet, _sql_pairs("", 60 * SECOND, 0)),
    "tolerance_join_drift": (tolerance_join_drift, _sql_pairs("", 60 * SECOND, 5 * SECOND)),
    "tolerance_join_per_host": (tolerance_join_host, SQL_PAIRS_PER_HOST),
    "curated_samples": (curated_samples, CURATED),
    "dedupe_last_wins": (dedupe_last_wins, DEDUPE),
    "aligned_samples": (aligned, ALIGNED),
    "poll_rollup": (poll_rollup, POLL_ROLLUP),
}
