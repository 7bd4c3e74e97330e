"""Parsers of collector text, descriptions, file names and embedded JSON.

All of them are column expressions, so they run inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rackpulse.functions.status import ERROR, UNKNOWN, as_column, bind

# Sensor names the fleet collector reads as inlet and exhaust.
INLET_SENSORS = ("Inlet Temp", "49-Sys Exhaust 1", "01-Inlet Ambient", "Temp_Inlet_MB")
EXHAUST_SENSORS = ("Exhaust Temp", "50-Sys Exhaust 2", "28-LOM Card", "Temp_Outlet")

# The workload names a sample file can carry.
WORKLOADS = (
    "nascent_idle_benchmark", "nascent_cpu_benchmark", "nascent_memory_benchmark",
    "nascent_gpu_benchmark", "nascent_disk_benchmark", "nascent_network_benchmark",
    "nascent_sleep_cpu_benchmark", "nascent_quick_test", "real",
)

JSON_READINGS = "map<string,map<string,string>>"


def text_lines(text: Column | str) -> Column:
    """Lines of a dump, without the empty one behind a final line end."""
    return F.split(F.regexp_replace(as_column(text), r"\r?\n\z", ""), r"\r?\n")


def is_blank(text: Column | str) -> Column:
    return F.coalesce(F.length(as_column(text)) == 0, F.lit(True))


def description_field(description: Column | str, key: str) -> Column:
    """Value of ``key`` in ``k:v;k:v``; the last one wins, parts that are not pairs are skipped."""
    pairs = F.filter(
        F.transform(F.split(as_column(description), ";"), lambda part: F.split(part, ":")),
        lambda pair: (F.size(pair) == 2) & (pair[0] == key),
    )
    return F.try_element_at(F.try_element_at(pairs, F.lit(-1)), F.lit(2))


def load_average(text: Column | str) -> Column:
    """Five-minute figure behind ``load average:``; empty output and output without a figure are the error code."""
    t = as_column(text)
    field = F.regexp_extract(t, r"load average:[^,]*,([^,]*)", 1)
    return F.when(is_blank(t), F.lit(float(ERROR))).otherwise(
        F.coalesce(F.trim(field).try_cast("double"), F.lit(float(ERROR)))
    )


def login_count(text: Column | str) -> Column:
    """Interactive sessions in a login listing: second word names a terminal."""
    t = as_column(text)
    words = F.transform(text_lines(t), lambda line: F.split(F.trim(line), r"\s+"))
    sessions = F.filter(
        words, lambda w: F.coalesce(F.try_element_at(w, F.lit(2)).rlike("pts|tty"), F.lit(False))
    )
    return F.when(is_blank(t), ERROR).otherwise(F.size(sessions))


def dcmi_instant_power(text: Column | str) -> Column:
    """Watts on the first line of a seven-line power dump."""
    t = as_column(text)
    watts = bind(
        text_lines(t),
        lambda lines: F.when(F.size(lines) == 7, F.regexp_extract(lines[0], r":\s*(\S+)", 1).try_cast("double"))
        .otherwise(F.lit(float(UNKNOWN))),
    )
    return F.when(is_blank(t), F.lit(float(ERROR))).otherwise(watts)


def dcmi_average_power(text: Column | str) -> Column:
    """Watts on the line with the average over the sample period."""
    t = as_column(text)
    watts = F.regexp_extract(t, r"Average power reading over sample period[^:\n]*:\s*(\S+)", 1)
    return F.when(is_blank(t), F.lit(float(ERROR))).otherwise(
        F.coalesce(watts.try_cast("double"), F.lit(float(UNKNOWN)))
    )


def sdr_temperature(text: Column | str, sensors: tuple[str, ...]) -> Column:
    """Last reading marked ``ok`` among the named sensors of an SDR dump, else unknown."""
    fields = F.transform(text_lines(text), lambda line: F.split(line, ","))
    good = F.filter(
        fields,
        lambda f: f[0].isin(*sensors) & F.coalesce(F.try_element_at(f, F.lit(4)) == "ok", F.lit(False)),
    )
    reading = F.try_element_at(F.try_element_at(good, F.lit(-1)), F.lit(2)).try_cast("double")
    return F.coalesce(reading, F.lit(float(UNKNOWN)))


def sensor_readings(text: Column | str, roles: Column | str) -> Column:
    """Readings of a sensor dump as a map, named by the product's sensor roles.

    ``roles`` maps a sensor name to the reading it feeds. CPU sensors add up to
    one reading; for any other reading the last sensor wins.
    """
    roles = as_column(roles)
    fields = F.transform(text_lines(text), lambda line: F.split(line, ","))
    entries = F.transform(fields, lambda f: F.struct(
        F.try_element_at(roles, f[0]).alias("name"), F.try_element_at(f, F.lit(2)).try_cast("double").alias("value")
    ))
    known = F.filter(entries, lambda e: e["name"].isNotNull() & e["value"].isNotNull())

    def named(found: Column) -> Column:
        other = F.filter(found, lambda e: e["name"] != "cpu_power")
        cpu_sum = F.aggregate(
            F.filter(found, lambda e: e["name"] == "cpu_power"), F.lit(0.0), lambda acc, e: acc + e["value"]
        )
        total = F.array(F.struct(F.lit("cpu_power").alias("name"), cpu_sum.alias("value")))
        return F.when(F.exists(found, lambda e: e["name"] == "cpu_power"), F.concat(other, total)).otherwise(other)

    return F.map_from_entries(bind(known, named))


def keyed_json(text: Column | str) -> Column:
    """Timestamp-keyed readings of a JSON text; several objects in a row merge, last key wins."""
    joined = F.regexp_replace(as_column(text), r"\}\s*\{", ",")
    # Rebuilding the map drops repeated keys, which the JSON reader keeps.
    return F.map_from_entries(F.map_entries(F.from_json(joined, JSON_READINGS)))


def double_readings(readings: Column | str) -> Column:
    """Numeric readings of a text map; arrays and other text are left out."""
    typed = F.transform_values(as_column(readings), lambda _, v: v.try_cast("double"))
    return F.map_filter(typed, lambda _, v: v.isNotNull() & ~F.isnan(v))


def sample_file_fields(name: Column | str, workloads: tuple[str, ...] = WORKLOADS) -> Column:
    """Struct of run, sequence, host, workload, type and kind from a sample file name.

    The workload list anchors the match, since host names may hold hyphens too.
    """
    n = as_column(name)
    pattern = (
        r"^(\d+_\d+)_(\d+)-(.+)-(" + "|".join(workloads) + r")-([^-]+)-(host|bmc)_data\.json$"
    )
    part = lambda i: F.regexp_extract(n, pattern, i)
    return F.when(
        n.rlike(pattern),
        F.struct(
            part(1).alias("run_ts"), part(2).try_cast("int").alias("seq"), part(3).alias("host"),
            part(4).alias("workload"), part(5).alias("wtype"), part(6).alias("kind"),
        ),
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; naive timestamps count as UTC."""
    return F.unix_micros(as_column(ts).cast("timestamp"))


def machine_links(base_url: str, system_id: Column | str) -> Column:
    """The links of an alert: power off, release, power on."""
    url = F.concat(F.lit(f"{base_url}/MAAS/#/machine/"), as_column(system_id))
    return F.array(
        *(F.concat(F.lit(f"{action} "), url) for action in ("Off", "Release", "On"))
    )


HOST_BUCKETS = 256


def host_bucket(host: Column | str) -> Column:
    """Storage bucket of a host."""
    return F.pmod(F.xxhash64(as_column(host)), F.lit(HOST_BUCKETS)).cast("int")
