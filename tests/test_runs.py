"""Runs replace themselves, failed attempts stay unseen."""

import pytest

from rackpulse.sinks import runs

SCHEMA = "host string, value int, part string"


def rows(spark, *values):
    return spark.createDataFrame([(f"h{v}", v, f"p{v % 2}") for v in values], SCHEMA)


def seen(spark, path):
    return sorted((r["run"], r["value"], r["part"]) for r in runs.read_runs(spark, path, SCHEMA).collect())


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    assert seen(spark, path) == [] and not runs.has_runs(spark, path)
    assert runs.write_run(rows(spark, 1, 2, 3), path, "2024-01-01 00:05:00", ["part"]) == 3
    runs.write_run(rows(spark, 7), path, "007", ["part"])
    runs.write_run(rows(spark, 1, 2), path, "2024-01-01 00:05:00", ["part"])
    assert seen(spark, path) == [("007", 7, "p1"), ("2024-01-01 00:05:00", 1, "p1"), ("2024-01-01 00:05:00", 2, "p0")]
    assert runs.replaced(spark, path, SCHEMA).count() == 1
    # A repetition that finds nothing leaves nothing.
    assert runs.write_run(rows(spark), path, "007", ["part"]) == 0
    assert {r for r, _, _ in seen(spark, path)} == {"2024-01-01 00:05:00"}
    assert {(r["run"], r["rows"]) for r in runs.in_force(spark, path).collect()} == {("007", 0), ("2024-01-01 00:05:00", 2)}


def test_an_attempt_that_fails_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    runs.write_run(rows(spark, 1), path, "a")

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(runs, "commit", broken)
    with pytest.raises(OSError, match="lost"):
        runs.write_run(rows(spark, 5, 6), path, "a")
    with pytest.raises(OSError, match="lost"):
        runs.write_run(rows(spark, 9), path, "b")
    assert seen(spark, path) == [("a", 1, "p1")] and runs.replaced(spark, path, SCHEMA).count() == 2


def test_commits_prune_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in range(3):
        runs.write_run(rows(spark, value), path, "a", ["part"])
    read = runs.read_runs(spark, path, SCHEMA)
    plan = read._jdf.queryExecution().toString()
    assert seen(spark, path) == [("a", 2, "p0")] and "dynamicpruning" in plan.lower()
