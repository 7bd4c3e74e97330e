"""Streams over files, compared with the batch form of the same operator."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.operators import lookback
from rackpulse.operators.series import SECOND, tolerance_join
from rackpulse.session import scratch_path
from rackpulse.sources.dimensions import product_temperatures
from rackpulse.streaming import joins, rollups, sinks, sources

START = datetime(2024, 1, 1)


def points(spark, folder, batches):
    for i, batch in enumerate(batches):
        rows = [(m, {"host": h}, START + timedelta(minutes=t), float(v)) for m, h, t, v in batch]
        spark.createDataFrame(rows, schemas.POINT).coalesce(1).write.mode("append").parquet(f"{folder}/b{i}")


def test_poll_rollup_and_late_points(spark, tmp_path):
    first = [("load_avg", "a", 1, 2.0), ("pwr_consumption", "a", 1, 100.0), ("load_avg", "b", 2, 0.0),
             ("pwr_consumption", "b", 2, -2.0), ("load_avg", "a", 3, 0.5), ("load_avg", "a", 60, 1.0)]
    folder = tmp_path / "points"
    points(spark, folder, [first])
    stream = sources.point_stream(spark, str(folder / "b0"))
    got = sinks.run_available(rollups.poll_status(stream), "t", str(tmp_path / "out")).collect()
    assert [(r["poll_start"], r["n_util"], r["n_unutil"], r["power_util"], r["power_unutil"]) for r in got] == [
        (START, 1, 1, 100.0, -2.0)]
    batch = rollups.poll_status(spark.read.schema(schemas.POINT).parquet(str(folder / "b0"))).collect()
    assert {r["poll_start"] for r in batch} == {START, START + timedelta(minutes=60)}


def test_aligned_stream(spark, tmp_path):
    points(spark, tmp_path / "p", [[("load_avg", "a", 1, 1.0), ("load_avg", "a", 2, 2.0), ("load_avg", "a", 90, 9.0)]])
    stream = sources.point_stream(spark, str(tmp_path / "p/b0"))
    got = sinks.run_available(rollups.aligned_stream(stream, ["measurement"], "time", "value", 300), "t", str(tmp_path / "o"))
    assert [(r["value"], r["n"]) for r in got.collect()] == [(2.0, 2)]


def test_tolerance_join_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    side = lambda n: sorted(rng.sample(range(100_000), n))
    host_of = lambda: rng.choice("ab")
    bmc = [(host_of(), t) for t in side(300)]
    host = [(host_of(), t) for t in side(400)]
    frame = lambda rows: spark.createDataFrame(
        [(h, START + timedelta(milliseconds=10 * t), str(t)) for h, t in rows], "host string, ts timestamp, payload string")
    # A last row far ahead moves the watermark past all slices.
    closing = [("z", 1_000_000)]
    for name, rows in (("bmc", bmc + closing), ("host", host + closing)):
        frame(rows).repartition(3).write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema("host string, ts timestamp, payload string").parquet(str(tmp_path / name))
    pairs = joins.tolerance_join_stream(read("bmc"), read("host"), 2 * SECOND, SECOND // 2, slice_seconds=60)
    got = sinks.run_available(pairs, "pairs", str(tmp_path / "out")).select("host", "bmc", "sample").collect()
    micros = lambda rows: frame(rows).select("host", F.unix_micros("ts").alias("t"), "payload")
    expected = tolerance_join(micros(bmc), micros(host), ["host"], 2 * SECOND, SECOND // 2).select(
        "host", "bmc_row.payload", F.col("host_row.payload").alias("sample")).collect()
    assert len(expected) > 50
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_sample_and_dump_streams(spark, tmp_path):
    folder = tmp_path / "samples"
    folder.mkdir()
    (folder / "20240101_000000_000-h1-real-production-host_data.json").write_text(
        json.dumps({"2024-01-01 00:00:05.0": {"cpuload_total": 3.0}, "2024-01-01 01:00:05.0": {"cpuload_total": -1.0}}))
    rows = sinks.run_available(
        sources.host_sample_stream(spark, str(folder)).select("host", "ts", F.col("readings")["util"].alias("util")),
        "s", str(tmp_path / "o1")).collect()
    assert sorted(r["util"] for r in rows) == ["-1", "1"]
    dumps = tmp_path / "dumps"
    dumps.mkdir()
    (dumps / "a.json").write_text(json.dumps({
        "host": "h1", "product": "DGX-1 (Default string)", "ts": "2024-01-01T00:00:00",
        "dcmi_text": "Average power reading over sample period: 118 Watts", "sensor_text": "Temp_Outlet,30\nPower_GPGPU0,9"}))
    row = sinks.run_available(sources.bmc_dump_stream(spark, str(dumps)), "d", str(tmp_path / "o2")).first()
    assert (row["window_secs"], row["readings"]) == (1, {"power": 118.0, "exhaust_temp": 30.0, "Power_GPGPU0": 9.0})


def test_hourly_segments_and_point_sink(spark, tmp_path):
    folder = tmp_path / "samples"
    folder.mkdir()
    for wtype in ("production", "benchmark"):
        (folder / f"20240101_000000_000-h1-real-{wtype}-bmc_data.json").write_text(
            json.dumps({"2024-01-01 00:00:05": {"power": 3.0}, "2024-01-01 01:00:05": {"power": 4.0}}))
    query = sinks.hourly_segments(
        sources.sample_stream(spark, str(folder)), str(tmp_path / "seg"), scratch_path(spark, "seg"), "1 second")
    query.processAllAvailable()
    query.stop()
    found = spark.read.parquet(str(tmp_path / "seg")).groupBy("wtype", "hour").count().collect()
    assert {(r["wtype"], r["hour"]): r["count"] for r in found} == {
        ("production", 0): 1, ("production", 1): 1, ("benchmark", -1): 2}
    points(spark, tmp_path / "p", [[("load_avg", "a", 1, 1.0)]])
    query = sinks.point_sink(
        sources.point_stream(spark, str(tmp_path / "p/b0")), str(tmp_path / "ps"), scratch_path(spark, "ps"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "ps")).count() == 1


def test_repeated_alert_batch_replaces_itself(spark, tmp_path):
    machine = [("h", "s", "u", ("lab",), "Deployed", "on", [], ["1.1.1.1"], "", ("DGX-1 (Default string)",), "/m")]
    machines = spark.createDataFrame(machine, schemas.MACHINE_RAW)
    users = spark.createDataFrame([("u", "u@example.org")], schemas.USERS)
    batch = spark.createDataFrame([("h", lookback.INLET, START, 300.0, 30.0)], schemas.MEASURE)
    check = sinks.temperature_alerts(machines, users, product_temperatures(spark), "http://x", str(tmp_path / "alerts"))
    check(batch, 4)
    check(batch, 4)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 1
