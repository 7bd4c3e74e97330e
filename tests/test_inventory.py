"""Machine selection, dictionaries, hardware groups, counters, alerts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.operators import inventory as inv
from rackpulse.operators import lookback, rollup
from rackpulse.plans import fleet_poll, temperature, utilisation
from rackpulse.sources.dimensions import (
    PRODUCT_FAMILIES, product_temperatures, sensor_profiles, skip_list, ups_oids,
)
from rackpulse.sources import files
from rackpulse.sources.readings import collector_readings, ups_points

DGX = "DGX-1 (Default string)"


def raw(spark, *rows):
    base = {"system_id": "s", "owner": "u1", "pool": ("lab",), "status_name": "Deployed", "power_state": "on", "tag_names": [],
            "ip_addresses": ["10.0.0.1"], "description": "", "hardware_info": (DGX,), "resource_uri": "/m"}
    names = schemas.MACHINE_RAW.fieldNames()
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], schemas.MACHINE_RAW)


def names(df, column="hostname"):
    return sorted(r[column] for r in df.select(column).collect())


def test_eligibility(spark):
    machines = raw(
        spark, {"hostname": "ok"}, {"hostname": "vm", "tag_names": ["virtual"]}, {"hostname": "new", "status_name": "New"},
        {"hostname": "failed", "status_name": "Failed commissioning"}, {"hostname": "busy", "status_name": "Commissioning"},
        {"hostname": "no-ip", "ip_addresses": []}, {"hostname": "skipped"},
    )
    assert names(inv.inventory_machines(machines)) == ["no-ip", "ok", "skipped"]
    assert names(inv.inventory_machines(machines, commissioning_too=True)) == ["busy", "no-ip", "ok", "skipped"]
    assert names(inv.telemetry_machines(machines, skip_list(spark, ("skipped",)))) == ["busy", "failed", "ok"]
    assert names(inv.telemetry_machines(machines, skip_list(spark, ("skipped",)), ["Deployed"])) == ["ok"]


def test_override_and_power_parameters(spark):
    managed = spark.createDataFrame([("a", "on"), ("b", "off")], "hostname string, power_state string")
    extra = spark.createDataFrame([("b", "on", "1.1.1.1")], "hostname string, power_state string, ip_address string")
    got = {r["hostname"]: (r["power_state"], r["ip_address"]) for r in inv.override_with(managed, extra).collect()}
    assert got == {"a": ("on", None), "b": ("on", "1.1.1.1")}
    parameters = spark.createDataFrame([("a", "x", "secret")], "hostname string, power_user string, power_pass string")
    assert inv.with_power_parameters(managed, parameters).columns == ["hostname", "power_state", "power_user"]


def curated(spark):
    rows = [
        ("h1", 0, "P1", ["C0", "C0"], ["D0", "D1"], [], 8), ("h2", 1, "P1", ["C0", "C0"], ["D1", "D0"], [], 8),
        ("h3", 2, "P0", ["C1"], ["D1", "D1"], ["G"], 4),
    ]
    full = []
    for host, pos, product, cpus, disks, gpus, cores in rows:
        full.append((host, "u1", "lab", "s", True, "V", product, cores, cores * 2, 1500.0, "I", cpus, [10**9], [750],
                     [("A", d, 10**12) for d in disks], [("N", "E")], [("NV", g, 9300) for g in gpus], "1.1.1.1", None, None, None))
    df = spark.createDataFrame(full, schemas.MACHINE_CURATED)
    order = spark.createDataFrame([(r[0], r[1]) for r in rows], "hostname string, position bigint")
    return df.join(order, "hostname")


def test_dictionary_codes_in_order_of_appearance(spark):
    got = {(r["attribute"], r["value"]): (r["code"], r["n_machines"])
           for r in inv.label_dictionary(inv.attribute_values(curated(spark))).collect()}
    assert got[("disks", "D0")] == (0, 2) and got[("disks", "D1")] == (1, 3)
    assert got[("system_product", "P1")] == (0, 2) and got[("system_product", "P0")] == (1, 1)
    assert got[("hostname", "h3")] == (2, 1) and got[("accelerators", "G")] == (0, 1)


def test_static_features(spark):
    machines = curated(spark)
    dictionary = inv.label_dictionary(inv.attribute_values(machines)).cache()
    hot = {r["hostname"]: r for r in inv.static_features(
        machines, dictionary, {"hostname": "1-hot", "system_product": "1-hot", "processor_product": "1-hot"}).collect()}
    assert (hot["h1"]["sp_P1"], hot["h1"]["sp_P0"], hot["h1"]["pp_C0"], hot["h1"]["hn_h1"], hot["h1"]["hn_h2"]) == (1, 0, 2, 1, 0)
    assert (hot["h3"]["disk_D1"], hot["h3"]["disk_D0"], hot["h3"]["accel_G"], hot["h3"]["disk_capacity"]) == (2, 0, 1, 2.0)
    assert [c for c in inv.static_features(machines, dictionary, {}).columns if c.startswith("disk_D")] == ["disk_D0", "disk_D1"]
    label = {r["hostname"]: r for r in inv.static_features(
        machines, dictionary, {"hostname": "label", "system_product": "label", "processor_product": "label"}).collect()}
    assert (label["h3"]["system_product"], label["h3"]["processor_product"], label["h3"]["hostname_code"]) == (1, 1, 2)


def test_hardware_groups(spark):
    machines = curated(spark)
    groups = inv.hardware_groups(machines)
    assert sorted((r["code"], r["n_machines"]) for r in groups.collect()) == [(0, 2), (1, 1)]
    members = inv.hardware_members(machines)
    samples = spark.createDataFrame([("h2",)], "host string")
    assert names(inv.members_with_samples(members, samples)) == ["h2"]
    assert names(inv.default_subset(members)) == ["h1", "h3"]


def test_fleet_compute(spark):
    got = {r["kind"]: r["tflops"] for r in inv.fleet_compute(curated(spark)).collect()}
    assert got == {"cpu": 4.5, "gpu": 9.3, "total": 13.8}


def test_fixed_dimensions(spark):
    assert (product_temperatures(spark).count(), ups_oids(spark).count()) == (16, 21)
    profiles = {r["product"]: r for r in sensor_profiles(spark).collect()}
    assert set(profiles) == set(PRODUCT_FAMILIES)
    assert len(profiles[DGX]["roles"]) == 26 and profiles[DGX]["window_secs"] == 1
    more = sensor_profiles(spark, {"New": {"window": 7, "inlet_temp": ["T"]}}, {"Box": "New"})
    assert {r["product"]: r["window_secs"] for r in more.collect()}["Box"] == 7


def test_ups_points(spark):
    rows = spark.createDataFrame(
        [("ups3", "1.3.6.1.4.1.318.1.1.1.9.3.3.1.4.1.1.2", datetime(2024, 1, 1), "37"),
         ("ups4", "SNMPv2-SMI::enterprises.318.1.1.1.9.3.3.1.16.1.1.3", datetime(2024, 1, 1), "12"),
         ("ups4", "1.3.6.1.4.1.318.9", datetime(2024, 1, 1), "1")],
        "ups string, oid string, time timestamp, raw string",
    )
    got = {(r["measurement"], r["value"], r["tags"]["io"], r["tags"]["phase"]) for r in ups_points(rows).collect()}
    assert got == {("current", 3.7, "output", "phase2"), ("percentpower", 12.0, "output", "phase3")}


def test_collector_codes(spark):
    rows = spark.createDataFrame(
        [("off", "off", "u", "admin"), ("err", "error", "u", "admin"), ("nouser", "on", None, "admin"), ("ok", "on", "u", None)],
        "hostname string, power_state string, user string, power_user string",
    ).withColumns({c: F.lit("") for c in ("last_text", "uptime_text", "dcmi_text", "sdr_text")})
    got = {r["hostname"]: r for r in collector_readings(rows, ["power_user"]).collect()}
    assert [got[h]["login_count"] for h in ("off", "err", "nouser", "ok")] == [-3, -1, -1, -2]
    assert [got[h]["load_avg"] for h in ("off", "err", "nouser", "ok")] == [-3.0, -1.0, -1.0, -2.0]
    assert [got[h]["pwr_consumption"] for h in ("off", "err", "nouser", "ok")] == [-2.0, -1.0, -2.0, -1.0]
    assert got["off"]["inlet_temp"] == -1.0


def test_power_counters_keep_codes_in_raw_sum(spark):
    rows = spark.createDataFrame([(1.0, 100.0), (2.0, -2.0), (0.0, 50.0), (-4.0, 9.0)], "load double, power double")
    got = {r["status"]: r for r in rollup.power_by_status(rows, "load", "power").collect()}
    assert (got["util"]["raw_sum"], got["util"]["raw_avg"], got["util"]["clean_sum"]) == (98.0, 49.0, 100.0)
    assert (got["off"]["raw_sum"], got["off"]["raw_avg"], got["unutil"]["raw_sum"]) == (0.0, 0.0, 50.0)


def test_fleet_points(spark):
    polled = spark.createDataFrame(
        [("a", "on", 1.5, 100.0), ("b", "off", -3.0, -1.0)], "hostname string, power_state string, load_avg double, pwr_consumption double"
    ).withColumn("time", fleet_poll.poll_stamp(F.lit("2024-01-01 00:00:00.7").cast("timestamp")))
    points = fleet_poll.fleet_points(polled)
    got = {(r["measurement"], r["tags"]["status"]): r["value"] for r in points.collect()}
    assert got[("util_status_count", "util")] == 1.0 and got[("util_status_count", "unutil")] == 0.0
    assert got[("machine_status_count", "pwr_sum")] == 100.0 and got[("machine_status_count", "total")] == 2.0
    assert got[("pwr_status_count", "off")] == -1.0 and len(got) == 16
    assert {r["time"] for r in points.collect()} == {datetime(2024, 1, 1)}


def _measures(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(h, m, start + timedelta(hours=t), 300.0, float(v)) for h, m, t, v in rows], schemas.MEASURE)


def test_utilisation_counters_and_alerts(spark, tmp_path):
    machines = raw(spark, {"hostname": "idle"}, {"hostname": "used"}, {"hostname": "dark"}, {"hostname": "free", "owner": None})
    rows = []
    for host, login, load in (("idle", 0, 0.01), ("used", 2, 0.0), ("dark", -3, 1.0), ("free", 0, 0.0)):
        rows += [(host, "login_count", 24, 1), (host, "login_count", 48, login), (host, "load_avg", 30, load),
                 (host, "load_avg", 60, 1), (host, "Pwr Consumption", 30, 100), (host, "Pwr Consumption", 60, 1)]
    verdicts = utilisation.machine_verdicts(machines, _measures(spark, rows))
    assert {r["host"]: r["verdict"] for r in verdicts.collect()} == {"idle": "zero", "used": "nonzero", "dark": "off"}
    users = spark.createDataFrame([("u1", "u1@example.org")], schemas.USERS)
    found = utilisation.alerts(verdicts, users, "http://x").collect()
    assert [(r["host"], r["email"], len(r["links"])) for r in found] == [("idle", "u1@example.org", 3)]
    counts = {r["metric"]: r["value"] for r in utilisation.counters(verdicts).collect()}
    assert (counts["util_off_count"], counts["util_zero_count"], counts["util_error_count"]) == (1.0, 1.0, 0.0)
    assert (counts["pwr_off_avg"], counts["pwr_unknown_avg"], counts["pwr_unutil_avg"]) == (0.0, 100.0, 100.0)
    assert {r["time"] for r in utilisation.counters(verdicts).collect()} == {datetime(2024, 1, 3)}
    stored = utilisation.nightly_run(
        machines, _measures(spark, rows), users, "http://x", str(tmp_path / "alerts"), str(tmp_path / "points"))
    assert stored.count() == 3
    assert [r["host"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == ["idle"]
    assert spark.read.parquet(str(tmp_path / "points")).count() == 9


def test_unsafe_temperatures(spark):
    machines = raw(
        spark, {"hostname": "inlet"}, {"hostname": "exhaust"}, {"hostname": "fine"}, {"hostname": "off", "power_state": "off"},
        {"hostname": "unlisted", "hardware_info": ("X",)},
    )
    rows = []
    for host, inlet, exhaust in (("inlet", 22, 30), ("exhaust", 21, 36), ("fine", 21, 35), ("off", 30, 50), ("unlisted", 20, 90)):
        rows += [(host, lookback.INLET, 1, 99), (host, lookback.INLET, 2, inlet), (host, lookback.EXHAUST, 2, exhaust)]
    unsafe = temperature.unsafe_machines(machines, _measures(spark, rows), product_temperatures(spark))
    assert names(unsafe, "host") == ["exhaust", "inlet"]


def test_stored_poll_feeds_the_verdict(spark, tmp_path):
    texts = {"last_text": "bob pts/0 x\n", "uptime_text": "load average: 1, 0.5, 0", "dcmi_text": "", "sdr_text": ""}
    machine = spark.createDataFrame([("a", "on", "bot", "admin", "secret")],
                                    "hostname string, power_state string, user string, power_user string, power_pass string")
    machine = machine.withColumns({k: F.lit(v) for k, v in texts.items()})
    for hour in (1, 2, 3):
        stamp = fleet_poll.poll_stamp(F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp"))
        polled = fleet_poll.poll(machine, stamp, ["power_user"])
        fleet_poll.store_poll(polled, str(tmp_path / "points"), str(tmp_path / "measures"), str(tmp_path / "dump"))
    assert spark.read.parquet(str(tmp_path / "points")).where("measurement = 'up_status'").count() == 3
    assert spark.read.json(str(tmp_path / "dump")).first()["power_pass"] == "xxxx"
    measures = files.measures(spark, str(tmp_path / "measures"))
    row = lookback.lookbacks(measures).first()
    assert (row["login_count"], row["load_avg"], row["mean_power"]) == (1.0, 0.5, None)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_one_split_are_dealt_and_details_stay_off_the_driver(spark, tmp_path):
    from rackpulse.catalog import tables as t

    rows = [(i, f"Brand#{i % 3}", "STEEL", 1 + i % 49) for i in range(50)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    facts = t.part_facts(spark, str(tmp_path))
    assert "hashpartitioning(p_partkey" in _plan(facts) and facts.count() == 50
    curated, rejects = inv.curate_machines(t.part_machines(spark, str(tmp_path)), t.hardware_texts(spark, str(tmp_path)))
    assert "Broadcast" not in _plan(curated) and "Broadcast" not in _plan(rejects)
    assert curated.count() == 50 and rejects.count() == 0
    links = inv.neighbour_links(t.hardware_texts(spark, str(tmp_path)))
    assert links.count() == sum(i % 3 != 0 for i in range(50))


def test_tasks_of_parts_follow_their_number(spark, tmp_path, monkeypatch):
    from rackpulse.catalog import tables as t

    rows = [(i, f"Brand#{i % 3}", "STEEL", 1 + i % 49) for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(t, "MACHINES_PER_TASK", 10)
    facts = t.part_facts(spark, str(tmp_path))
    assert ", 20), REPARTITION_BY_NUM" in _plan(facts) and facts.count() == 200
    counts = inv.part_counts(inv.attribute_values(t.curated_parts(spark, str(tmp_path))))
    assert counts.where("attribute = 'hostname' AND n = 1").count() == 200
