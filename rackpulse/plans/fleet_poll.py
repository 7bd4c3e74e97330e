"""One poll of the fleet: readings of every machine, points, and fleet counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.status import up_code
from rackpulse.operators import rollup
from rackpulse.session import materialise
from rackpulse.sinks import tables
from rackpulse.sources.readings import collector_readings

# The metric of the measure table each measurement is stored under.
METRIC_NAMES = {
    "login_count": "login_count", "load_avg": "load_avg", "pwr_consumption": "Pwr Consumption",
    "up_status": "up", "inlet_temp": "Inlet Temp", "exhaust_temp": "Exhaust Temp",
}
HOST_MEASUREMENTS = ["login_count", "load_avg", "pwr_consumption", "up_status", "inlet_temp", "exhaust_temp"]


def poll_stamp(now: Column | None = None) -> Column:
    """The one time all machines of a poll share, to the second."""
    return F.date_trunc("second", F.current_timestamp() if now is None else now)


def poll(machines: DataFrame, stamp: Column, bmc_fields: list[str]) -> DataFrame:
    """Readings per machine with the poll's time."""
    return collector_readings(machines, bmc_fields).withColumn("up_status", up_code("power_state")).withColumn(
        "time", stamp
    )


def host_points(polled: DataFrame) -> DataFrame:
    return rollup.host_points(polled, "hostname", "time", HOST_MEASUREMENTS)


def store_poll(
    polled: DataFrame, point_path: str | None = None, measure_path: str | None = None, dump_path: str | None = None
) -> DataFrame:
    """Stores one poll where a path is given: points, measures of each machine, redacted host dump.

    The poll is written once and returned, since every store starts from it. The poll's time is the run of its points and
    measures, so a poll that is stored again replaces itself. Points that could not be written are an
    error, raised when the other stores are done.
    """
    kept = materialise(polled, "poll")
    run = str(kept.agg(F.max("time")).first()[0])
    points = host_points(kept)
    stored = True
    if point_path:
        stored = tables.points(points.unionByName(fleet_points(kept)), point_path, run)
    if measure_path:
        metric = F.create_map(*[F.lit(x) for pair in METRIC_NAMES.items() for x in pair])
        named = points.withColumn("measurement", metric[F.col("measurement")])
        tables.measures(tables.measures_from_points(named, F.col("tags")["host"], 300.0), measure_path, run)
    if dump_path:
        tables.curated_machines(tables.redacted(kept), dump_path, as_json=True)
    if not stored:
        raise OSError(f"the points of this poll are not in {point_path}; store the poll again")
    return kept


def fleet_points(polled: DataFrame) -> DataFrame:
    """Counters of a poll: utilisation status, power state, and power per utilisation status."""
    by = ["time"]
    util = rollup.status_counts(polled, "load_avg", by)
    state = rollup.power_state_points(rollup.power_state_rollup(polled, "power_state", "pwr_consumption", by), by)
    power = rollup.power_by_status(polled, "load_avg", "pwr_consumption", by)
    return (
        rollup.counter_points(util, "util_status_count", "time", "status", "n")
        .unionByName(rollup.counter_points(state, "machine_status_count", "time", "status", "value"))
        .unionByName(rollup.counter_points(power, "pwr_status_count", "time", "status", "raw_sum"))
    )
