"""Small fixed dimensions. Their size does not depend on the data, so they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse import schemas

# Compute figure of known accelerators.
GPU_UNITS = {
    "GK110BGL [Tesla K40m]": 4290,
    "GP100GL [Tesla P100 PCIe 12GB]": 9300,
    "GP100GL [Tesla P100 PCIe 16GB]": 9300,
    "GP100GL [Tesla P100 SXM2 16GB]": 9300,
    "GP102 [GeForce GTX 1080 Ti]": 11340,
    "GP102 [TITAN Xp]": 12150,
    "NVIDIA Corporation": 14200,
}

# Safe exhaust range of each product, (minimum, maximum) in degrees.
PRODUCT_TEMPERATURES = {
    "PowerEdge R730 (SKU=NotProvided;ModelName=PowerEdge R730)": (5, 40),
    "ProLiant DL380 Gen9 (719064-B21)": (10, 35),
    "PowerEdge R630 (SKU=NotProvided;ModelName=PowerEdge R630)": (10, 35),
    "PRIMERGY RX2540 M2 (ABN:K1566-V401-5622)": (10, 35),
    "PRIMERGY RX2540 M2 (ABN:K1566-V401-2420)": (10, 35),
    "ProLiant DL380 G7 (583914-B21)": (10, 35),
    "ProLiant DL380 Gen10 (868703-B21)": (10, 35),
    "SYS-7048GR-TR (Default string)": (10, 35),
    "ProLiant DL360p Gen8 (654081-B21)": (10, 35),
    "PRIMERGY RX2530 M4 (ABN:K1592-V401-506)": (5, 45),
    "DGX-1 (Default string)": (5, 35),
    "PowerEdge T630 (SKU=NotProvided;ModelName=PowerEdge T630)": (10, 35),
    "PowerEdge R740 (SKU=NotProvided;ModelName=PowerEdge R740)": (10, 35),
    "ProLiant XL170r Gen10 (867055-B21)": (10, 35),
    "ProLiant DL380 Gen10 (868706-B21)": (10, 35),
    "-[7947IDS]- (XxXxXxX)": (10, 35),
}

# UPS object ids below the enterprise prefix; phases 1 to 3 end the id.
UPS_ENTERPRISE = ("1.3.6.1.4.1.", "SNMPv2-SMI::enterprises.")
UPS_BRANCHES = (
    ("318.1.1.1.9.2.3.1.3.1.1", "input", "voltage"),
    ("318.1.1.1.9.3.3.1.3.1.1", "output", "voltage"),
    ("318.1.1.1.9.2.3.1.6.1.1", "input", "current"),
    ("318.1.1.1.9.3.3.1.4.1.1", "output", "current"),
    ("318.1.1.1.9.3.3.1.7.1.1", "output", "load"),
    ("318.1.1.1.9.3.3.1.10.1.1", "output", "percentload"),
    ("318.1.1.1.9.3.3.1.16.1.1", "output", "percentpower"),
)
UPS_PHASES = (1, 2, 3)


def _numbered(pattern: str, numbers: range) -> list[str]:
    return [pattern.format(i) for i in numbers]


# Sensors of each machine family, by the reading they feed, and the sampling window.
SENSOR_FAMILIES: dict[str, dict] = {
    "PowerEdge": {
        "window": 60, "inlet_temp": ["Inlet Temp"], "exhaust_temp": ["Exhaust Temp"],
        "own": _numbered("Fan{}", range(1, 7)),
    },
    "DGX": {
        "window": 1, "inlet_temp": ["Temp_Inlet_MB"], "exhaust_temp": ["Temp_Outlet"],
        "own": _numbered("Fan_SYS{}_1", range(4)) + _numbered("Fan_SYS{}_2", range(4))
        + _numbered("Power_GPGPU{}", range(8)) + _numbered("Temp_GPGPU{}", range(8)),
    },
    "RX2540": {
        "window": 5, "inlet_temp": ["Systemboard 1"], "exhaust_temp": ["Systemboard 2"],
        "cpu_power": ["CPU1 Power", "CPU2 Power"], "own": _numbered("FAN{} SYS", range(1, 6)),
    },
    "RX2530": {
        "window": 5, "inlet_temp": ["Systemboard 1"], "exhaust_temp": ["Systemboard 2"],
        "systemboard_power": ["Systemboard Pwr"],
        "own": _numbered("FAN{} SYS", range(1, 9)) + ["Total Power", "Total Power Out"],
    },
    "Proliant": {"window": 300},
    "OpenBmc": {"window": 20},
    "Default": {"window": 1},
}

# The family of each registered product.
PRODUCT_FAMILIES = {
    "PowerEdge T630 (SKU=NotProvided;ModelName=PowerEdge T630)": "PowerEdge",
    "PowerEdge R630 (SKU=NotProvided;ModelName=PowerEdge R630)": "PowerEdge",
    "PowerEdge R730 (SKU=NotProvided;ModelName=PowerEdge R730)": "PowerEdge",
    "PowerEdge R740 (SKU=NotProvided;ModelName=PowerEdge R740)": "PowerEdge",
    "PowerEdge R7525 (SKU=NotProvided;ModelName=PowerEdge R7525)": "PowerEdge",
    "DGX-1 (Default string)": "DGX",
    "PRIMERGY RX2530 M4 (ABN:K1592-V401-506)": "RX2530",
    "PRIMERGY RX2540 M2 (ABN:K1566-V401-5622)": "RX2540",
    "PRIMERGY RX2540 M2 (ABN:K1566-V401-2420)": "RX2540",
    "-[7947IDS]- (XxXxXxX)": "Default",
    "IBMPOWER9": "OpenBmc",
    "ProLiant DL380 G7 (583914-B21)": "Default",
    "ProLiant DL360p Gen8 (654081-B21)": "Default",
    "ProLiant DL380 Gen9 (719064-B21)": "Proliant",
    "ProLiant DL380 Gen10 (868703-B21)": "Proliant",
    "ProLiant DL380 Gen10 (868706-B21)": "Proliant",
    "ProLiant XL170r Gen10 (867055-B21)": "Proliant",
    "SYS-7048GR-TR (Default string)": "Default",
}


def product_temperatures(spark: SparkSession) -> DataFrame:
    rows = [(p, low, high) for p, (low, high) in PRODUCT_TEMPERATURES.items()]
    return F.broadcast(spark.createDataFrame(rows, schemas.PRODUCT_TEMP))


def read_product_temperatures(spark: SparkSession, path: str) -> DataFrame:
    """Safe ranges from one JSON object, product to ``{min, max}``."""
    text = spark.read.text(path, wholetext=True)
    limits = F.from_json("value", "map<string,struct<min:int,max:int>>")
    return text.select(F.explode(limits).alias("product", "limits")).select("product", "limits.*")


def ups_oids(spark: SparkSession) -> DataFrame:
    """Object id without its enterprise prefix, direction, reading type and phase."""
    rows = [
        (f"{branch}.{phase}", io, kind, f"phase{phase}")
        for branch, io, kind in UPS_BRANCHES for phase in UPS_PHASES
    ]
    return F.broadcast(spark.createDataFrame(rows, schemas.OID))


def bare_oid(oid: str):
    """Object id without either spelling of the enterprise prefix."""
    prefixes = "|".join(p.replace(".", r"\.") for p in UPS_ENTERPRISE)
    return F.regexp_replace(oid, rf"^({prefixes})", "")


def sensor_profiles(
    spark: SparkSession, families: dict[str, dict] | None = None, products: dict[str, str] | None = None
) -> DataFrame:
    """One row per product: family, window and the map from sensor name to reading.

    New products are supported by passing further families and products.
    """
    families = {**SENSOR_FAMILIES, **(families or {})}
    rows = []
    for product, family in {**PRODUCT_FAMILIES, **(products or {})}.items():
        sensors = families[family]
        roles = {
            name: (name if reading == "own" else reading)
            for reading, names in sensors.items() if reading != "window" for name in names
        }
        rows.append((product, family, sensors["window"], roles))
    return F.broadcast(spark.createDataFrame(rows, schemas.SENSOR_PROFILE))


def skip_list(spark: SparkSession, hostnames: tuple[str, ...] = ()) -> DataFrame:
    """Machines the fleet collectors leave out; ``sources.files.host_list`` reads them from a file."""
    return spark.createDataFrame([(h,) for h in hostnames], "hostname string")
