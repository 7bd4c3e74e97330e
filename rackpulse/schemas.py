"""Declared schemas; nothing in the library infers one from data."""

from pyspark.sql import types as T

S, L, D, B, I, TS = (
    T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


MACHINE_RAW = _struct(
    ("hostname", S), ("system_id", S), ("owner", S), ("pool", _struct(("name", S))),
    ("status_name", S), ("power_state", S), ("tag_names", T.ArrayType(S)),
    ("ip_addresses", T.ArrayType(S)), ("description", S),
    ("hardware_info", _struct(("system_product", S))), ("resource_uri", S),
)

POWER_PARAMETERS = _struct(
    ("hostname", S), ("power_user", S), ("power_pass", S), ("power_driver", S), ("power_address", S)
)

MACHINE_CURATED = _struct(
    ("hostname", S), ("owner", S), ("pool", S), ("system_id", S), ("inband", B),
    ("system_vendor", S), ("system_product", S), ("cores", L), ("threads", L), ("mflops", D),
    ("processor_vendor", S), ("processor_product", T.ArrayType(S)),
    ("memory_modules", T.ArrayType(L)), ("psus", T.ArrayType(L)),
    ("disks", T.ArrayType(_struct(("vendor", S), ("product", S), ("size", L)))),
    ("nics", T.ArrayType(_struct(("vendor", S), ("product", S)))),
    ("accelerators", T.ArrayType(_struct(("vendor", S), ("product", S), ("mflops", L)))),
    ("ip_address", S), ("user", S), ("rack", S), ("unit", S),
)

# Readings stay text until curation: a few host readings are arrays.
SAMPLE_RAW = _struct(
    ("run_ts", S), ("seq", I), ("host", S), ("workload", S), ("wtype", S), ("kind", S),
    ("ts", TS), ("readings", T.MapType(S, S)),
)

# Readings with a column of their own; the others stay in the ``extra`` map.
SAMPLE_COLUMNS = (
    "power", "power_p0", "power_p1", "power_px", "util", "cpuload_total", "loadavg", "mem_util",
    "inlet_temp", "exhaust_temp", "cpu_power", "fan_power", "hdd_power", "systemboard_power",
)

SAMPLE_CURATED = _struct(
    ("host", S), ("wtype", S), ("run_ts", S), ("seq", I), ("bmc_ts", TS), ("host_ts", TS),
    *((name, D) for name in SAMPLE_COLUMNS),
    ("extra", T.MapType(S, D)),
)

POINT = _struct(("measurement", S), ("tags", T.MapType(S, S)), ("time", TS), ("value", D))
POINT_STORED = _struct(*((f.name, f.dataType) for f in POINT.fields), ("date", T.DateType()))
SEGMENT = _struct(*((f.name, f.dataType) for f in SAMPLE_RAW.fields), ("date", T.DateType()), ("hour", I))
ALERT = _struct(("owner", S), ("email", S), ("subject", S), ("host", S), ("links", T.ArrayType(S)), ("reason", S))
MEASURE = _struct(("host", S), ("metric", S), ("ts", TS), ("granularity", D), ("value", D))
PRODUCT_TEMP = _struct(("product", S), ("min", I), ("max", I))
OID = _struct(("oid", S), ("io", S), ("type", S), ("phase", S))
USERS = _struct(("username", S), ("email", S))
GPU = _struct(("product", S), ("mflops", L))
SENSOR_PROFILE = _struct(
    ("product", S), ("family", S), ("window_secs", I), ("roles", T.MapType(S, S))
)
DICTIONARY = _struct(
    ("attribute", S), ("encoding", S), ("value", S), ("code", L), ("n_machines", L)
)
