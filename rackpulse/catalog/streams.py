"""Streaming queries, run to the end over the files present."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.series import HOUR, POLL_ROLLUP, SQL_PAIRS_PER_HOST, points, shaped_rollup
from rackpulse.catalog.tables import MEASURES, fixed, sql_fixed
from rackpulse.functions.parse import micros
from rackpulse.operators.series import SECOND
from rackpulse.session import prepare, scratch_path
from rackpulse.streaming.handover import open_windows, run_to_end, window_closed
from rackpulse.streaming.joins import is_answered, open_pairs, tolerance_join_stream
from rackpulse.streaming.rollups import aligned_stream, poll_status

WINDOW_HOURS = 6


def _event_stream(spark, d):
    """Events as a file stream of their parquet table."""
    schema = t.read(spark, d, "events").schema
    files = prepare(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def _measure_stream(spark, d):
    """Load and power measures of the event stream, by the rules of the batch view."""
    kind, n, v = F.col("event_type"), F.col("event_id"), F.col("value")
    coded = F.when(n % 50 == 0, -3.0).when(n % 50 == 1, -2.0).when(n % 50 == 2, -1.0).when(n % 50 == 3, 0.0)
    is_load = kind.isin("click", "view")
    load = F.when(v < 25, 0.02).otherwise(v / 10)
    return _event_stream(spark, d).where(is_load | (kind == "purchase")).select(
        F.when(is_load, "load_avg").otherwise("pwr_consumption").alias("measurement"),
        F.create_map(F.lit("host"), F.col("user_id").cast("string")).alias("tags"),
        F.col("ts").alias("time"), F.coalesce(coded, F.when(is_load, load).otherwise(v)).alias("value"),
    )


def stream_poll_rollup(spark, d):
    """Poll counters of all windows: those the stream has closed, and the open ones from the rows behind its watermark."""
    seconds = WINDOW_HOURS * 3600
    rolled = poll_status(_measure_stream(spark, d), f"{WINDOW_HOURS} hours")
    rest = open_windows(points(spark, d), "time", seconds, lambda rows: poll_status(rows, f"{WINDOW_HOURS} hours"), "poll_start")
    return shaped_rollup(run_to_end(rolled, scratch_path(spark, "poll-rollup"), rest, window_closed("poll_start", seconds)))


def stream_aligned(spark, d):
    """Last value of each hour per measurement, open hours included."""
    last = lambda rows: aligned_stream(rows, ["measurement"], "time", "value", 3600)
    rest = open_windows(points(spark, d), "time", 3600, last, "window_start")
    table = run_to_end(last(_measure_stream(spark, d)), scratch_path(spark, "aligned"), rest, window_closed("window_start", 3600))
    return table.select("measurement", micros("window_start").alias("window_us"), fixed("value").alias("value"), "n")


STREAM_ALIGNED = f"""
WITH {MEASURES}
SELECT CASE metric WHEN 'load_avg' THEN 'load_avg' ELSE 'pwr_consumption' END AS measurement,
  epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, {sql_fixed('arg_max(value, ts)')} AS value, count(*) AS n
FROM m WHERE metric IN ('load_avg', 'Pwr Consumption') GROUP BY 1, 2"""


def stream_tolerance_join(spark, d):
    """Views and purchases paired with the other events of the same user, as the batch join pairs them.

    Rows whose reach the watermark has passed are answered by the stream, the others by the batch join behind it.
    """
    tolerance, drift = 6 * HOUR, 5 * SECOND
    bmc = F.col("event_type").isin("view", "purchase")
    side = lambda events, mine: events.where(mine).select(
        F.col("user_id").cast("string").alias("host"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"),
        F.col("event_id").cast("string").alias("payload"),
    )
    live = _event_stream(spark, d)
    pairs = tolerance_join_stream(side(live, bmc), side(live, ~bmc), tolerance, drift, slice_seconds=30 * 86400, lateness_seconds=600)
    stored = t.read(spark, d, "events")
    table = run_to_end(
        pairs, scratch_path(spark, "pairs"),
        lambda watermark: open_pairs(side(stored, bmc), side(stored, ~bmc), watermark, tolerance, drift),
        lambda watermark: is_answered(watermark, tolerance, drift),
    )
    return table.select(F.col("bmc").cast("bigint").alias("bmc_id"), F.col("sample").cast("bigint").alias("host_id"))


QUERIES = {
    "stream_poll_rollup": (stream_poll_rollup, f"{POLL_ROLLUP}"),
    "stream_aligned_samples": (stream_aligned, STREAM_ALIGNED),
    "stream_tolerance_join": (stream_tolerance_join, SQL_PAIRS_PER_HOST),
}
