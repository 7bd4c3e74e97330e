"""Files written in the shape of a fleet installation, read back through the scans and sinks."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rackpulse.functions.parse import WORKLOADS
from rackpulse import schemas
from rackpulse.operators.features import EncodeOptions
from rackpulse.plans.load_inference import encoded_from_raw
from rackpulse.sinks import tables
from rackpulse.sources import dimensions, files

START = "2024-01-01 00:00:"


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def sample_files(folder):
    put(folder, "20240101_000000_000-h-1-real-production-bmc_data.json", {
        START + "05.000000": {"power": 120.0, "inlet_temp": 20.0, "Fan1": 3000.0}, START + "10.000000": {"power": -2},
        START + "15": {"power": 130.0, "inlet_temp": 21.0}})
    put(folder, "20240101_000000_000-h-1-real-production-host_data.json", {
        START + "05.900000": {"cpuload_total": 5.0, "util": 1, "net_util": [1, 2]}, START + "14.500000": {"cpuload_total": 2.0, "util": 1}})
    put(folder, "notes.json", {"x": 1})


def test_samples_to_encoded(spark, tmp_path):
    sample_files(tmp_path / "mmd")
    raw = files.samples(spark, str(tmp_path / "mmd"))
    assert raw.schema == schemas.SAMPLE_RAW or raw.columns == schemas.SAMPLE_RAW.fieldNames()
    assert raw.count() == 5
    subset = spark.createDataFrame([("h-1",)], "hostname string")
    encoded = encoded_from_raw(raw, subset, EncodeOptions(inlet_temp=True, cpuload="class"), "production", ["real"])
    rows = sorted((r["time"], r["overall_power"], r["inlet_temp"], r["util"], r["load"]) for r in encoded.collect())
    assert rows == [(datetime(2024, 1, 1, 0, 0, 5), 120.0, 20.0, 1, 1), (datetime(2024, 1, 1, 0, 0, 15), 130.0, 21.0, 1, 1)]
    tables.encoded(encoded, str(tmp_path / "enc"))
    back = files.encoded_samples(spark, str(tmp_path / "enc"), ["h-1"])
    assert back.count() == 2 and "host_bucket" not in back.columns
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(host_bucket" in plan or "host_bucket" in plan.split("PartitionFilters")[1]
    tables.encoded_parts(encoded, str(tmp_path / "parts"))
    assert spark.read.csv(str(tmp_path / "parts/groundtruth"), header=True).columns == ["host", "time", "util", "load"]


def test_curated_samples_round_trip(spark, tmp_path):
    from rackpulse.operators.series import curate_samples

    sample_files(tmp_path / "mmd")
    curated = curate_samples(files.samples(spark, str(tmp_path / "mmd")))
    tables.curated_samples(curated, str(tmp_path / "cur"))
    assert (tmp_path / "cur" / "date=2024-01-01").is_dir()
    assert files.curated_samples(spark, str(tmp_path / "cur")).count() == 2


def test_inventory_files(spark, tmp_path):
    machine = {"hostname": "h1", "system_id": "s1", "owner": None, "pool": {"name": "lab"}, "status_name": "Deployed",
               "power_state": "on", "tag_names": [], "ip_addresses": ["1.1.1.1"], "description": "",
               "hardware_info": {"system_product": "P"}, "resource_uri": "/m", "more": 1}
    put(tmp_path / "raw", "h1-machine.json", machine)
    put(tmp_path / "raw2", "all.json", [machine, {**machine, "hostname": "h2"}])
    assert files.machines(spark, str(tmp_path / "raw")).first()["pool"]["name"] == "lab"
    assert files.machines(spark, str(tmp_path / "raw2")).count() == 2
    put(tmp_path / "pp", "h1-power_parameters.json", {"power_user": "u", "power_pass": "secret", "power_driver": "LAN"})
    row = files.power_parameters(spark, str(tmp_path / "pp")).first()
    assert row.asDict() == {"hostname": "h1", "power_user": "u", "power_driver": "LAN", "power_address": None}
    put(tmp_path / "det", "h1-details.xml", "<x/>")
    assert tuple(files.hardware_details(spark, str(tmp_path / "det")).first()) == ("h1", "<x/>")
    put(tmp_path / "list", "machines.json", ["h2", "h1"])
    assert [tuple(r) for r in files.host_list(spark, str(tmp_path / "list")).collect()] == [(0, "h2"), (1, "h1")]
    put(tmp_path / "users", "users.json", [{"username": "u", "email": "u@example.org", "x": 1}])
    assert tuple(files.users(spark, str(tmp_path / "users")).first()) == ("u", "u@example.org")
    put(tmp_path / "dump", "h1-ipmitool-sdr.txt", "Inlet Temp,21,degrees C,ok\n")
    assert files.text_dumps(spark, str(tmp_path / "dump"), "sdr").first()["host"] == "h1"
    put(tmp_path / "bench", "h1.json", {START + "01.0": {"cpuload_total": 1}})
    assert files.benchmark_result(spark, str(tmp_path / "bench")).first()["readings"] == {"cpuload_total": "1"}
    put(tmp_path / "bench2", f"20240101_120000_1-h-1-{WORKLOADS[0]}-x-host_data.json", {START + "01.0": {"cpuload_total": 1}})
    row = files.benchmark_result(spark, str(tmp_path / "bench2")).first()
    assert (row["run_ts"], row["host"], row["workload"]) == ("20240101_120000", "h-1", WORKLOADS[0])
    put(tmp_path / "limits", "limits.json", {"P": {"min": 5, "max": 40}})
    limits = dimensions.read_product_temperatures(spark, str(tmp_path / "limits"))
    assert tuple(limits.first()) == ("P", 5, 40)


def test_roster(spark, tmp_path):
    pytest.importorskip("yaml")
    put(tmp_path, "empty.yml", "machines:\n  -\n")
    put(tmp_path, "none.yml", "machines:\n")
    put(tmp_path, "two.yml", "machines:\n  - hostname: a\n    ip_address: 1.1.1.1\n    power_pass: p\n  - hostname: a\n")
    assert files.roster(spark, str(tmp_path / "empty.yml")).count() == 0
    assert files.roster(spark, str(tmp_path / "none.yml")).count() == 0
    rows = files.roster(spark, str(tmp_path / "two.yml"))
    assert rows.count() == 1 and "power_pass" not in rows.columns
    put(tmp_path / "folder", "a.yml", "machines:\n  - hostname: a\n    user: first\n  - hostname: b\n")
    put(tmp_path / "folder", "b.yml", "machines:\n  - hostname: a\n    user: last\n")
    rows = files.roster(spark, str(tmp_path / "folder")).collect()
    assert sorted((r["hostname"], r["user"]) for r in rows) == [("a", "last"), ("b", None)]


def test_encoded_csv_joins_by_key(spark, tmp_path):
    put(tmp_path, "h1-X.csv", "time,overall_power\nt2,20\nt1,10\n")
    put(tmp_path, "h1-y.csv", "time,util,load\nt1,0,0.0\nt2,1,9.0\n")
    rows = files.encoded_csv(spark, str(tmp_path), ["overall_power"], ["h1"])
    assert sorted((r["time"], r["overall_power"], r["load"]) for r in rows.collect()) == [("t1", 10.0, 0.0), ("t2", 20.0, 9.0)]


def test_point_and_measure_sinks(spark, tmp_path):
    points = spark.createDataFrame(
        [("load_avg", {"host": "a"}, datetime(2024, 1, 1), 1.0), ("up_status", {"host": "a"}, datetime(2024, 1, 2), 0.0)],
        schemas.POINT,
    )
    path = str(tmp_path / "points")
    assert tables.points(points, path) and tables.points(points, path)
    assert spark.read.parquet(path).where("measurement = 'load_avg'").count() == 2
    assert tables.points(points, "nosuchscheme://x") is False
    measures = tables.measures_from_points(points, F.col("tags")["host"], 300.0)
    tables.measures(measures, str(tmp_path / "measures"))
    back = files.measures(spark, str(tmp_path / "measures"))
    assert {(r["host"], r["metric"], r["value"]) for r in back.collect()} == {("a", "load_avg", 1.0), ("a", "up_status", 0.0)}


def test_other_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("h", "x", 1.234567, 2.0)], "hostname string, power_pass string, memory_capacity double, disk_capacity double")
    assert tables.redacted(rows).first()["power_pass"] == "xxxx"
    tables.static_features(rows, str(tmp_path / "static"))
    got = spark.read.csv(str(tmp_path / "static"), header=True).first()
    assert (got["memory_capacity"], got["disk_capacity"]) == ("1.23", "2.00")
    tables.host_list(rows, str(tmp_path / "hosts"))
    assert [tuple(r) for r in files.host_list(spark, str(tmp_path / "hosts")).collect()] == [(None, "h")]
    put(tmp_path / "bad", "machines.json", "h1\nh2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.host_list(spark, str(tmp_path / "bad")).collect()
    alerts = spark.createDataFrame([("u", "e", "s", "h", "r", ["l"])], "owner string, email string, subject string, host string, reason string, links array<string>")
    tables.alerts(alerts, str(tmp_path / "alerts"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1
    tables.csv_export(rows, str(tmp_path / "csv"))
    sample_files(tmp_path / "mmd")
    tables.raw_segments(files.samples(spark, str(tmp_path / "mmd")), str(tmp_path / "seg"))
    assert (tmp_path / "seg" / "date=2024-01-01" / "hour=0").is_dir()
    machines = spark.createDataFrame([], schemas.MACHINE_CURATED)
    tables.curated_machines(machines, str(tmp_path / "mach"))
    assert files.curated_machines(spark, str(tmp_path / "mach")).count() == 0
    entries = spark.createDataFrame([("disks", "n-hot", "D0", 0, 2)], schemas.DICTIONARY)
    tables.dictionary(entries, str(tmp_path / "dict"))
    assert files.dictionary(spark, str(tmp_path / "dict")).first()["code"] == 0
