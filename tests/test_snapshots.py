"""Snapshot store: run numbers from state, recovery, JSON bundles."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import snapshots


def week_of(spark, day, subjects, avg=1.0):
    date = dt.date.fromisoformat(day)
    runs = spark.createDataFrame([(s, date, date, "g", None, 0, 0, 0.0, 0, None) for s in subjects], snapshots.RUN_SCHEMA)
    metrics = spark.createDataFrame([(s, date, date, "hrv", avg, 1.0, 1.0, 1.0, 1.0, "up", "ms") for s in subjects], snapshots.METRIC_SCHEMA)
    return metrics, runs


def numbers(spark, path):
    return sorted((r.subject_id, str(r.report_date), r.run_number) for r in snapshots.load_snapshots(spark, path)[1].collect())


def test_numbers_follow_the_order_of_saving(spark, tmp):
    for day, who in (("2024-01-14", [1, 2]), ("2024-01-07", [1]), ("2024-01-21", [1, 2, 3]), ("2024-01-07", [1, 3])):
        snapshots.save_snapshot(spark, *week_of(spark, day, who), tmp)
    assert numbers(spark, tmp) == [(1, "2024-01-07", 2), (1, "2024-01-14", 1), (1, "2024-01-21", 3),
                                   (2, "2024-01-14", 1), (2, "2024-01-21", 2), (3, "2024-01-07", 2), (3, "2024-01-21", 1)]


def test_a_save_reads_its_date_and_the_state_only(spark, tmp):
    for day in ("2024-01-07", "2024-01-14"):
        snapshots.save_snapshot(spark, *week_of(spark, day, [1, 2]), tmp)
    # Any other date's files are not even opened.
    for folder, _, inside in os.walk(os.path.join(tmp, "runs", "report_date=2024-01-07")):
        for f in inside:
            with open(os.path.join(folder, f), "wb") as broken:
                broken.write(b"no parquet")
    snapshots.save_snapshot(spark, *week_of(spark, "2024-01-21", [1, 9]), tmp)
    got = snapshots.load_snapshots(spark, tmp)[1].where("report_date = DATE'2024-01-21'").collect()
    assert sorted((r.subject_id, r.run_number) for r in got) == [(1, 3), (9, 1)]


@pytest.mark.parametrize("lost", ["metrics", "done"])
def test_failed_save_then_another_date(spark, tmp, monkeypatch, lost):
    """A save that stops between its tables, or before its last line."""
    snapshots.save_snapshot(spark, *week_of(spark, "2024-01-07", [1]), tmp)
    log = snapshots._log
    with monkeypatch.context() as m:
        def stops(spark, path, number, phase, state):
            if phase == "done":
                raise OSError("lost")
            log(spark, path, number, phase, state)
        m.setattr(snapshots, "_log", stops)
        with pytest.raises(OSError):
            snapshots.save_snapshot(spark, *week_of(spark, "2024-01-14", [1, 2]), tmp)
    again = ["2024-01-14", "2024-01-21"] if lost == "metrics" else ["2024-01-21", "2024-01-14"]
    for day in again:
        snapshots.save_snapshot(spark, *week_of(spark, day, [1, 2], 5.0), tmp)
    assert numbers(spark, tmp) == [(1, "2024-01-07", 1), (1, "2024-01-14", 2), (1, "2024-01-21", 3),
                                   (2, "2024-01-14", 1), (2, "2024-01-21", 2)]


def test_store_without_a_log(spark, tmp):
    metrics, runs = week_of(spark, "2024-01-07", [1])
    runs.withColumn("run_number", F.lit(4).cast("long")).write.partitionBy("report_date").parquet(os.path.join(tmp, "runs"))
    metrics.write.partitionBy("report_date").parquet(os.path.join(tmp, "metrics"))
    snapshots.save_snapshot(spark, *week_of(spark, "2024-01-14", [1]), tmp)
    assert numbers(spark, tmp) == [(1, "2024-01-07", 4), (1, "2024-01-14", 5)]


def test_bundles_hold_many_subjects_and_both_forms_load(spark, tmp):
    everyone = range(200)
    weeks = [week_of(spark, day, everyone, avg) for day, avg in (("2024-01-14", 2.0), ("2024-01-07", 1.0))]
    metrics, runs = (a.unionByName(b) for a, b in zip(*weeks))
    runs = runs.withColumn("run_number", F.lit(1).cast("long"))
    path = os.path.join(tmp, "json")
    snapshots.write_snapshots_json(metrics, runs, path)
    assert 0 < len([f for _, _, inside in os.walk(path) for f in inside if f.endswith(".json")]) <= 8
    few = metrics.where("subject_id < 3").withColumn("subject_id", F.col("subject_id") + 1000)
    single = os.path.join(tmp, "single")
    snapshots.write_snapshots_json_files(few, runs.where("subject_id < 3").withColumn("subject_id", F.col("subject_id") + 1000), single)
    shutil.copytree(single, path, dirs_exist_ok=True, ignore=lambda _, names: [n for n in names if n.startswith(("_", "."))])
    got, got_runs = snapshots.load_snapshots_json(spark, path)
    key = lambda df: sorted((r.subject_id, str(r.report_date), r.metric, r.avg) for r in df.collect())
    assert key(got) == key(metrics.unionByName(few)) and got_runs.count() == 406
    only = os.path.join(tmp, "files")
    snapshots.write_snapshots_json_files(few, runs.limit(0), only)
    assert snapshots.load_snapshots_json(spark, only)[0].count() == 0
    assert snapshots.load_snapshots_json(spark, os.path.join(tmp, "nothing"))[0].count() == 0
