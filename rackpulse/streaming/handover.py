"""From a stream to a batch: scheduled runs whose result is complete.

A stream emits what its watermark has closed; the last windows stay in its state until more rows come. A scheduled run therefore
stores the watermark it ended with and computes what is still open with the batch form of the operator, over the rows behind that
watermark alone. The open part is one run of a table (see ``sinks.runs``): the next run replaces it as a whole, and because
readers take closed rows up to the watermark of the open part they see, each window is there once at any time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.functions.parse import micros
from rackpulse.sinks import runs

_OPEN = "open"


def run_to_end(
    stream: DataFrame, path: str, open_part: Callable[[int], DataFrame], is_closed: Callable[[int], Column]
) -> DataFrame:
    """Process all rows present and return the complete result.

    ``open_part`` computes what a stream with a given watermark (in microseconds) has not emitted, ``is_closed`` tells for a
    row of the result whether it has. Closed rows, state and the open part lie below ``path``; a later run goes on from there.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/closed")
        .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    reached = [p.eventTime["watermark"] for p in query.recentProgress if "watermark" in (p.eventTime or {})]
    before = watermark(spark, path)
    now = max([_micros(w) for w in reached] + ([before] if before is not None else [0]))
    runs.write_run(open_part(now), f"{path}/open", _OPEN, note=str(now))
    return complete(spark, path, stream.schema, is_closed)


def _micros(text: str) -> int:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return round((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000) * 1000


def _in_force(spark: SparkSession, path: str):
    """Attempt and watermark (the note of its commit) of the open part in force; none before the first run."""
    return runs.in_force(spark, f"{path}/open").first() if runs.has_runs(spark, f"{path}/open") else None


def watermark(spark: SparkSession, path: str) -> int | None:
    """Watermark that the last run ended with, in microseconds."""
    last = _in_force(spark, path)
    return None if last is None else int(last["note"])


def complete(spark: SparkSession, path: str, schema, is_closed: Callable[[int], Column]) -> DataFrame:
    """Closed rows up to the watermark of the open part in force, and that part."""
    last = _in_force(spark, path)
    closed = spark.read.schema(schema).parquet(f"{path}/closed").where(is_closed(int(last["note"])))
    still = runs.read_attempt(spark, f"{path}/open", schema, last["run"], last["attempt"])
    return closed.unionByName(still)


def window_closed(start: str, seconds: int) -> Callable[[int], Column]:
    """For rows of tumbling windows: the watermark has reached the window's end."""
    return lambda watermark_us: micros(start) + seconds * 1_000_000 <= watermark_us


def open_windows(
    rows: DataFrame, ts: str, seconds: int, operator: Callable[[DataFrame], DataFrame], start: str
) -> Callable[[int], DataFrame]:
    """The batch form of a windowed operator over the windows that the watermark has not reached the end of.

    Only rows of those windows are read: the filter on the time reaches the scan.
    """
    def part(watermark_us: int) -> DataFrame:
        span = seconds * 1_000_000
        first = watermark_us // span * span  # start of the earliest open window
        return operator(rows.where(F.col(ts) >= F.timestamp_micros(F.lit(first)))).where(~window_closed(start, seconds)(watermark_us))

    return part
