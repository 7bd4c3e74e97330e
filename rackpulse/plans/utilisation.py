"""Which machines were under-used on the last day, who owns them, how much power they drew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.parse import machine_links
from rackpulse.functions.status import verdict_of
from rackpulse.operators.lookback import lookbacks
from rackpulse.operators.rollup import counter_points, verdict_counts, verdict_power
from rackpulse.operators.skew import keyed_join
from rackpulse.session import materialise
from rackpulse.sinks import tables

SUBJECT = "Under utilization alert"


def machine_verdicts(machines: DataFrame, measures: DataFrame) -> DataFrame:
    """Verdict of every owned machine whose login count was fetched last night."""
    owned = machines.where(F.col("owner").isNotNull()).select(
        F.col("hostname").alias("host"), "owner", "system_id"
    )
    return owned.join(lookbacks(measures), "host").withColumn("verdict", verdict_of("login_count", "load_avg"))


def alerts(verdicts: DataFrame, users: DataFrame, base_url: str) -> DataFrame:
    """One row per under-used machine with its owner's address and action links.

    Long form on purpose: the machines of one owner are never gathered in one row.
    """
    owners = users.select(F.col("username").alias("owner"), "email")
    return keyed_join(verdicts.where("verdict = 'zero'"), owners, ["owner"]).select(
        "owner", "email", F.lit(SUBJECT).alias("subject"), "host", F.lit("under-utilised").alias("reason"),
        machine_links(base_url, "system_id").alias("links"),
    )


def machines_per_owner(machines: DataFrame) -> DataFrame:
    return machines.where(F.col("owner").isNotNull()).groupBy("owner").agg(F.count("*").alias("n_machines"))


def counters(verdicts: DataFrame) -> DataFrame:
    """Counts per verdict and power sums, stamped with the newest anchor."""
    stamped = verdicts.select("verdict", "mean_power", "anchor")
    counts = verdict_counts(stamped).select(
        F.concat(F.lit("util_"), "verdict", F.lit("_count")).alias("metric"), F.col("n").cast("double").alias("value")
    )
    power = verdict_power(stamped)
    newest = stamped.agg(F.max("anchor")).scalar()
    return counts.unionByName(power).withColumn("time", newest)


def nightly_run(
    machines: DataFrame, measures: DataFrame, users: DataFrame, base_url: str,
    alert_path: str | None = None, point_path: str | None = None,
) -> DataFrame:
    """The daily job: verdicts, and where a path is given alert rows and fleet counters.

    The verdicts are written once, since alerts and counters both start from them. The day of the newest login count is the run, so
    a job that runs again replaces what it wrote.
    """
    verdicts = materialise(machine_verdicts(machines, measures), "verdicts")
    run = str(verdicts.agg(F.max(F.to_date("anchor"))).first()[0])
    if alert_path:
        tables.alerts(alerts(verdicts, users, base_url), alert_path, run)
    if point_path and not tables.points(counter_measures(verdicts), point_path, run):
        raise OSError(f"the counters of this run are not in {point_path}; run it again")
    return verdicts


def counter_measures(verdicts: DataFrame) -> DataFrame:
    """The counters as points of the fleet resource."""
    return counter_points(counters(verdicts), "total_machines", "time", "metric", "value")
