"""Parsers and class rules on hand-written text."""

import pytest
from pyspark.sql import functions as F

from rackpulse.functions import hardware as hw
from rackpulse.functions import parse, status
from rackpulse.sources.readings import bmc_readings, dump_summary, open_bmc_samples


def value(spark, text, build):
    return spark.createDataFrame([(text,)], "x string").select(build(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("user:bot;rack:r1;unit:7;note", ("bot", "r1", "7")),
    ("rack:a;rack:b;user:x:y", (None, "b", None)),
    ("", (None, None, None)),
])
def test_description(spark, text, expected):
    assert tuple(value(spark, text, lambda c: parse.description_field(c, k)) for k in ("user", "rack", "unit")) == expected


def test_uptime(spark):
    line = "10:00 up 3 days, 1 user, load average: 0.10, 0.05, 0.01"
    assert value(spark, line, parse.load_average) == 0.05
    assert value(spark, "", parse.load_average) == -2.0


def test_login_count(spark):
    text = "bob pts/0 10.0.0.9 Mon Jan 1\namy tty1 x\nreboot system boot\n\nwtmp begins Mon\nsingle\n"
    assert value(spark, text, parse.login_count) == 2
    assert value(spark, "", parse.login_count) == -2


def test_dcmi(spark):
    lines = ["Instantaneous power reading: 120 Watts", "b", "c", "Average power reading over sample period: 118 Watts", "e", "f", "g"]
    text = "\n".join(lines) + "\n"
    assert value(spark, text, parse.dcmi_instant_power) == 120.0
    assert value(spark, text, parse.dcmi_average_power) == 118.0
    assert value(spark, "\n".join(lines[:6]), parse.dcmi_instant_power) == -1.0
    assert value(spark, "", parse.dcmi_instant_power) == -2.0
    assert value(spark, "no such line", parse.dcmi_average_power) == -1.0


def test_sdr(spark):
    text = "Inlet Temp,21,degrees C,ok\nTemp_Outlet,35,degrees C,ns\nshort\n"
    assert value(spark, text, lambda c: parse.sdr_temperature(c, parse.INLET_SENSORS)) == 21.0
    assert value(spark, text, lambda c: parse.sdr_temperature(c, parse.EXHAUST_SENSORS)) == -1.0


def test_sensor_readings_by_profile(spark):
    rx = "PRIMERGY RX2540 M2 (ABN:K1566-V401-5622)"
    rows = spark.createDataFrame(
        [(1, rx, "", "CPU1 Power,30\nCPU2 Power,12\nFAN1 SYS,4000\nOther,1\n"), (2, "nothing known", "", "a,1"), (3, rx, "", "")],
        "id int, product string, dcmi_text string, sensor_text string",
    )
    known, rejects = bmc_readings(rows)
    found = {r["id"]: r["readings"] for r in known.collect()}
    assert found[1] == {"power": -2.0, "cpu_power": 42.0, "FAN1 SYS": 4000.0}
    assert found[3] == {"power": -2.0}
    assert [r["id"] for r in rejects.collect()] == [2]


def test_open_bmc(spark):
    text = '{"t1":{"power":1}}{"t2":{"power":2},"t1":{"power":3}}'
    rows = open_bmc_samples(spark.createDataFrame([("h", text), ("i", "\n"), ("j", "")], "host string, text string"))
    assert {(r["host"], r["key"], r["readings"]["power"]) for r in rows.collect()} == {("h", "t1", "3"), ("h", "t2", "2")}


def test_sample_file_name(spark):
    name = "20240101_000000_003-rack-1-nascent_cpu_benchmark-production-bmc_data.json"
    got = value(spark, name, parse.sample_file_fields)
    assert tuple(got) == ("20240101_000000", 3, "rack-1", "nascent_cpu_benchmark", "production", "bmc")
    assert value(spark, "machines.json", parse.sample_file_fields) is None


def test_dump_summary(spark):
    rows = spark.createDataFrame([(1, True, "a\nb\n"), (2, True, ""), (3, False, None)], "id int, reachable boolean, text string")
    assert {r["id"]: (r["result"], r["n_lines"]) for r in dump_summary(rows).collect()} == {1: (0, 2), 2: (-2, 0), 3: (-1, 0)}


XML = """<?xml version="1.0"?><list><node id="m" class="system"><product>P1</product><vendor>V1</vendor><node id="core" class="bus">
 <node id="cpu:0" class="processor"><product>C0</product><vendor>I</vendor><size units="Hz">2000000000</size>
  <configuration><setting id="cores" value="8"/><setting id="enabledcores" value="8"/><setting id="threads" value="16"/></configuration></node>
 <node id="memory" class="memory"><node id="bank:0" class="memory"><size units="bytes">17179869184</size></node><node id="bank:1" class="memory"/></node>
 <node id="power:0" class="power"><capacity units="mWh">750</capacity></node>
 <node id="disk:0" class="disk"><vendor>A</vendor><product>D0</product><size units="bytes">5000</size></node>
 <node id="disk:1" class="disk"><product>D1</product><size units="bytes">6000</size></node>
 <node id="network:0" class="network"><vendor>N</vendor><product>E10</product></node>
 <node id="display:0" class="display"><vendor>Matrox X</vendor><product>G200</product></node>
 <node id="display:1" class="display"><vendor>NV</vendor><product>GP102 [TITAN Xp]</product></node></node></node></list>"""
EMPTY_LLDP = '<?xml version="1.0"?><lldp label="x"/>'
FULL_LLDP = (
    '<?xml version="1.0"?><lldp><interface name="eth0"><chassis><id>00:11</id></chassis><vlan vlan-id="7"/></interface>'
    '<interface name="eth1"><chassis/></interface></lldp>'
)


@pytest.mark.parametrize("lldp", [EMPTY_LLDP, FULL_LLDP])
@pytest.mark.parametrize("first", [True, False])
def test_split_details(spark, lldp, first):
    text = f"{lldp}\n{XML}\n" if first else f"{XML}\n{lldp}\n"
    got = value(spark, text, hw.split_details)
    assert got["lldp"].startswith(lldp) or got["lldp"] == lldp
    assert got["hardware"] == XML


def test_neighbours(spark):
    got = value(spark, FULL_LLDP, hw.neighbours_of)
    assert [tuple(n) for n in got] == [("eth0", "00:11", "7")]


def _machine(spark, details):
    from rackpulse import schemas
    from rackpulse.operators.inventory import curate_machines

    raw = spark.createDataFrame(
        [("h1", "s1", "u1", ("lab",), "Deployed", "on", [], ["10.0.0.1"], "user:cse_bot;rack:r1", ("P1",), "/m/s1")],
        schemas.MACHINE_RAW,
    )
    return curate_machines(raw, spark.createDataFrame([("h1", details)], "hostname string, details string"))


def test_curated_machine(spark):
    curated, rejects = _machine(spark, f"{EMPTY_LLDP}\n{XML}")
    m = curated.first()
    assert (m["cores"], m["threads"], m["mflops"]) == (8, 16, 512.0)
    assert (m["memory_modules"], m["psus"], m["processor_product"]) == ([17179869184], [750], ["C0"])
    assert [tuple(x) for x in m["disks"]] == [("A", "D0", 5000)]
    assert [tuple(x) for x in m["accelerators"]] == [("NV", "GP102 [TITAN Xp]", 12150)]
    assert (len(m["nics"]), m["inband"], m["rack"], m["ip_address"]) == (1, True, "r1", "10.0.0.1")
    assert rejects.count() == 0


@pytest.mark.parametrize("old,new,reason", [
    ('units="bytes">5000', 'units="KiB">5000', "disk size not in bytes"),
    ('units="mWh"', 'units="W"', "power capacity not in mWh"),
    ("</list>", "</lost></list>", "document not readable"),
])
def test_rejected_machine(spark, old, new, reason):
    curated, rejects = _machine(spark, f"{EMPTY_LLDP}\n{XML.replace(old, new)}")
    assert curated.count() == 0
    assert [r["reason"] for r in rejects.collect()] == [reason]


def test_class_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.02, 0.03, 5.0, 10.0, 10.5, 40.0, 40.5)], "x double")
    got = rows.select(status.cpu_load_class("x").alias("c"), status.load_average_class("x").alias("l"),
                      status.cpu_load_class("x", 15.0).alias("t"), status.util_label("x", 5.0).alias("u")).collect()
    assert [r["c"] for r in got] == [0, 1, 1, 1, 1, 2, 2, 3]
    assert [r["l"] for r in got] == [0, 0, 1, 1, 1, 2, 2, 3]
    assert [r["t"] for r in got] == [0, 0, 0, 0, 0, 0, 2, 3]
    assert [r["u"] for r in got] == [0, 0, 0, 0, 1, 1, 1, 1]


def test_status_and_verdict(spark):
    values = spark.createDataFrame([(float(x),) for x in (2, 0, -1, -2, -3, -4)], "x double")
    assert [r[0] for r in values.select(status.status_of("x")).collect()] == ["util", "unutil", "unknown", "error", "off", None]
    cases = [(-3.0, 1.0, "off"), (-2.0, 1.0, "error"), (-1.0, 9.0, "unknown"), (2.0, -1.0, "unknown"),
             (1.0, 0.0, "nonzero"), (0.0, 0.04, "nonzero"), (0.0, 0.03, "zero")]
    rows = spark.createDataFrame([c[:2] for c in cases], "n double, l double").select(status.verdict_of("n", "l"))
    assert [r[0] for r in rows.collect()] == [c[2] for c in cases]


def test_up_code(spark):
    rows = spark.createDataFrame([("error",), ("on",), ("off",), ("x",)], "p string").select(status.up_code("p"))
    assert [r[0] for r in rows.collect()] == [-1, 1, 0, -2]
