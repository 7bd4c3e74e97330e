"""Windowed roll-ups of live points, and samples aligned to their window.

Points later than the watermark are dropped; a batch run over the stored points
has no such limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.status import STATUSES, status_of

POLL = "5 minutes"
LATENESS = "10 minutes"


def poll_status(points: DataFrame, poll: str = POLL, lateness: str = LATENESS) -> DataFrame:
    """Machines and power per utilisation status of every poll window.

    First the last load and power of each host in the window, then the counters;
    both steps are aggregations in append mode. Works on batch frames as well.
    """
    host = F.col("tags")["host"]
    newest = lambda m: F.max_by("value", F.when(F.col("measurement") == m, F.struct("time", "value")))
    per_host = (
        points.where(F.col("measurement").isin("load_avg", "pwr_consumption"))
        .withWatermark("time", lateness)
        .groupBy(F.window("time", poll).alias("poll"), host.alias("host"))
        .agg(newest("load_avg").alias("load"), newest("pwr_consumption").alias("power"))
    )
    status = status_of("load")
    return per_host.groupBy("poll").agg(
        *[F.count_if(status == s).alias(f"n_{s}") for s in STATUSES],
        *[
            F.coalesce(F.sum(F.when(status == s, F.col("power"))), F.lit(0.0)).alias(f"power_{s}")
            for s in STATUSES
        ],
    ).select(F.col("poll.start").alias("poll_start"), *[f"n_{s}" for s in STATUSES], *[f"power_{s}" for s in STATUSES])


def aligned_stream(
    samples: DataFrame, keys: list[str], ts: str, value: str, seconds: int, lateness: str = LATENESS
) -> DataFrame:
    """Last value per window a sampler aligns to."""
    return (
        samples.withWatermark(ts, lateness)
        .groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys)
        .agg(F.max_by(value, F.struct(ts, value)).alias(value), F.count("*").alias("n"))
        .select(*keys, F.col("w.start").alias("window_start"), value, "n")
    )
