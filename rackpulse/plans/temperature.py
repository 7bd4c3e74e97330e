"""Running machines whose last inlet or exhaust temperature is out of the safe range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.parse import machine_links
from rackpulse.operators.lookback import EXHAUST, INLET
from rackpulse.operators.skew import keyed_join

SUBJECT = "Unsafe operating temperature alert"

# Highest safe inlet temperature in degrees.
MAX_INLET = 21


def latest_temperatures(measures: DataFrame) -> DataFrame:
    """Last inlet and exhaust temperature per host, as two columns; of equal times the larger value."""
    wanted = measures.where(F.col("metric").isin(INLET, EXHAUST))
    newest = lambda m: F.max_by("value", F.when(F.col("metric") == m, F.struct("ts", "value")))
    return wanted.groupBy("host").agg(newest(INLET).alias("inlet_temp"), newest(EXHAUST).alias("exhaust_temp"))


def unsafe_machines(machines: DataFrame, measures: DataFrame, limits: DataFrame) -> DataFrame:
    """Owned, running machines over a limit; a product without limits has no exhaust check."""
    running = machines.where((F.col("power_state") == "on") & F.col("owner").isNotNull()).select(
        F.col("hostname").alias("host"), "owner", "system_id", F.col("hardware_info.system_product").alias("product")
    )
    checked = running.join(latest_temperatures(measures), "host").join(limits, "product", "left")
    hot_inlet = F.coalesce(F.col("inlet_temp") > MAX_INLET, F.lit(False))
    hot_exhaust = F.coalesce(F.col("exhaust_temp") > F.col("max"), F.lit(False))
    return checked.withColumns({"inlet_flag": hot_inlet, "exhaust_flag": hot_exhaust}).where(
        "inlet_flag OR exhaust_flag"
    )


def alerts(unsafe: DataFrame, users: DataFrame, base_url: str) -> DataFrame:
    owners = users.select(F.col("username").alias("owner"), "email")
    return keyed_join(unsafe, owners, ["owner"]).select(
        "owner", "email", F.lit(SUBJECT).alias("subject"), "host", F.lit("unsafe temperature").alias("reason"),
        machine_links(base_url, "system_id").alias("links"),
    )
