"""Stateful stream, metric log with its registry, written order, weekly run."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from pulsegrid.model import MetricDim
from pulsegrid.sources import reports

DIM = MetricDim(agg={"steps": "sum"})


def arrive(spark, folder, rows):
    data = [(s, m, v, dt.datetime.fromisoformat(t)) for s, m, v, t in rows]
    spark.createDataFrame(data, "subject_id long, metric string, value double, start_ts timestamp").coalesce(1) \
        .write.mode("append").parquet(folder)


def run(spark, tmp, watermark="3 days"):
    from pulsegrid.streaming.daily import run_daily

    schema = "subject_id long, metric string, value double, start_ts timestamp"
    stream = spark.readStream.schema(schema).parquet(os.path.join(tmp, "in"))
    return run_daily(stream, os.path.join(tmp, "days"), os.path.join(tmp, "ck"), watermark)


def daily(spark, tmp):
    from pulsegrid.streaming.daily import daily_table

    return sorted((r.subject_id, r.metric, str(r.date), r.value) for r in daily_table(spark, os.path.join(tmp, "days"), DIM).collect())


def test_state_takes_late_rows_and_drops_too_late_ones(spark, tmp):
    folder = os.path.join(tmp, "in")
    arrive(spark, folder, [(1, "steps", 10.0, "2024-01-01 08:00:00"), (1, "steps", 5.0, "2024-01-04 08:00:00"), (1, "hr", 60.0, "2024-01-04 09:00:00")])
    assert run(spark, tmp) == {"rows": 3, "late": 0}
    assert daily(spark, tmp) == [(1, "hr", "2024-01-04", 60.0), (1, "steps", "2024-01-01", 10.0), (1, "steps", "2024-01-02", 0.0),
                                 (1, "steps", "2024-01-03", 0.0), (1, "steps", "2024-01-04", 5.0)]
    # Late by two days: the day's total grows; the other days aren't rewritten.
    untouched = os.path.join(tmp, "days", "date=2024-01-01")
    before = sorted(os.listdir(untouched))
    arrive(spark, folder, [(1, "steps", 7.0, "2024-01-02 08:00:00"), (1, "hr", 70.0, "2024-01-04 23:00:00"), (1, "hr", None, "2024-01-09 10:00:00")])
    assert run(spark, tmp)["late"] == 0
    assert sorted(os.listdir(untouched)) == before
    want = [(1, "hr", "2024-01-04", 65.0), (1, "steps", "2024-01-01", 10.0), (1, "steps", "2024-01-02", 7.0),
            (1, "steps", "2024-01-03", 0.0), (1, "steps", "2024-01-04", 5.0)]
    assert daily(spark, tmp) == want
    assert run(spark, tmp)["rows"] == 0 and daily(spark, tmp) == want
    # Past the watermark (January 6): dropped, and counted.
    arrive(spark, folder, [(1, "steps", 1000.0, "2024-01-01 09:00:00")])
    assert run(spark, tmp) == {"rows": 1, "late": 1} and daily(spark, tmp) == want


def test_same_batch_again_changes_nothing(spark, tmp):
    from pulsegrid.streaming.daily import read_days, upsert_days

    days = spark.createDataFrame([(1, "steps", 3.0, 1, 1, dt.date(2024, 1, 1)), (2, "steps", 4.0, 1, 1, dt.date(2024, 1, 1))],
                                 "subject_id long, metric string, total double, n_values long, n long, date date")
    for batch in (days, days, days.where("subject_id = 1").withColumn("total", F.lit(9.0)), days.where("subject_id = 1").withColumn("total", F.lit(9.0))):
        upsert_days(batch, tmp)
    assert sorted((r.subject_id, r.total) for r in read_days(spark, tmp).collect()) == [(1, 9.0), (2, 4.0)]


LOG = "subject_id long, metric string, date date, value double, unit string, trend string, arrow string"


def log_rows(spark, rows):
    return spark.createDataFrame([(s, m, dt.date.fromisoformat(d), v, "", t, t) for s, m, d, v, t in rows], LOG)


def log(spark, root):
    return sorted((r.subject_id, str(r.date), r.value, r.trend) for r in reports.read_metric_log(spark, root).collect())


def data_files(root):
    return {os.path.join(d, f) for d, _, inside in os.walk(root) for f in inside if f.endswith(".parquet")}


def test_new_page_writes_its_own_history_only(spark, tmp):
    history = [(1, "hrv", f"2024-01-{k:02d}", float(k), "flat") for k in range(1, 21)]
    reports.write_metric_log(spark, log_rows(spark, history), tmp, "2024-01-20")
    reports.write_metric_log(spark, log_rows(spark, [(1, "hrv", "2024-01-27", 27.0, "up")]), tmp, "2024-01-27")
    before = data_files(os.path.join(tmp, "metric_log"))
    late = [(2, "hrv", f"2024-01-{k:02d}", float(-k), "flat") for k in range(1, 28)]
    reports.write_metric_log(spark, log_rows(spark, late + [(1, "hrv", "2024-01-27", 28.0, "up")]), tmp, "2024-01-27")
    new = data_files(os.path.join(tmp, "metric_log")) - before
    assert {f.split("metric_log" + os.sep)[1].split(os.sep)[0] for f in new} == {"history", "pages", "rows"}
    assert all("date=2024-01-27" in f for f in new if os.sep + "rows" + os.sep in f)
    touched = spark.read.parquet(*[f for f in new if os.sep + "history" + os.sep in f])
    assert touched.count() == 27 and touched.where("subject_id <> 2").count() == 0
    assert log(spark, tmp) == sorted([(s, d, v, t) for s, _, d, v, t in history + late] + [(1, "2024-01-27", 28.0, "up")])
    assert {(r.subject_id, str(r.since)) for r in reports.read_metric_pages(spark, tmp).collect()} == {(1, "2024-01-20"), (2, "2024-01-27")}


def test_reported_row_replaces_a_back_filled_point_and_runs_repeat(spark, tmp):
    reports.write_metric_log(spark, log_rows(spark, [(1, "hrv", "2024-01-27", 1.0, "flat"), (2, "hrv", "2024-01-26", 2.0, "flat")]), tmp, "2024-01-20")
    for _ in range(2):
        reports.write_metric_log(spark, log_rows(spark, [(1, "hrv", "2024-01-27", 5.0, "up"), (2, "hrv", "2024-01-27", 6.0, "up")]), tmp, "2024-01-27")
    # A series that isn't reported again keeps its row of that date.
    reports.write_metric_log(spark, log_rows(spark, [(1, "hrv", "2024-01-27", 7.0, "down")]), tmp, "2024-01-27")
    assert log(spark, tmp) == [(1, "2024-01-27", 7.0, "down"), (2, "2024-01-26", 2.0, "flat"), (2, "2024-01-27", 6.0, "up")]


def test_lost_registry_line_means_new_pages_again(spark, tmp, monkeypatch):
    rows = log_rows(spark, [(1, "hrv", "2024-01-19", 1.0, "flat")])
    made = reports.materialize

    def fails_late(df, name):
        if name == "metric-log-pages":
            made(df, name)
            spark.createDataFrame([(1,)], "x int").write.parquet(os.path.join(tmp, "metric_log", "history", "fill=lost"))
            raise OSError("lost")
        return made(df, name)

    with monkeypatch.context() as m:
        m.setattr(reports, "materialize", fails_late)
        with pytest.raises(OSError):
            reports.write_metric_log(spark, rows, tmp, "2024-01-20")
    assert reports.read_metric_log(spark, tmp) is None
    reports.write_metric_log(spark, rows, tmp, "2024-01-20")
    assert log(spark, tmp) == [(1, "2024-01-19", 1.0, "flat")]


def test_order_check_finds_what_is_out_of_order(spark, tmp):
    rows = spark.createDataFrame([(1, 3), (1, 2), (2, 9), (1, 1)], "subject_id long, sessions long").coalesce(1)
    path = os.path.join(tmp, "wrong")
    rows.write.parquet(path)
    got = reports.out_of_order(spark.read.parquet(path), ["subject_id", "-sessions"]).first()
    assert (got.n_rows, got.n_out_of_order) == (4, 1)
    got = reports.out_of_order(spark.read.parquet(path), ["subject_id", "sessions"]).first()
    assert got.n_out_of_order == 2
    right = reports.write_report(rows, tmp, "right", order_by=["subject_id", "-sessions"])
    assert reports.out_of_order(spark.read.parquet(right), ["subject_id", "-sessions"]).first().n_out_of_order == 0
    none = reports.write_report(rows.limit(0), tmp, "none", order_by=["subject_id"])
    assert tuple(reports.out_of_order(spark.read.parquet(none), ["subject_id"]).first()) == (0, 0)


def test_back_dated_run_reports_no_later_week(spark, tmp):
    from pulsegrid.plans.analysis import run as weekly
    from test_ingest import HEART, days, put

    put(os.path.join(tmp, "in"), "subject=1.xml", *days(HEART, [60 + k % 5 for k in range(30)]))
    dst, steps = os.path.join(tmp, "out"), []
    for as_of in ("2024-01-10", "2024-01-17", "2024-01-24", "2024-01-31"):
        weekly(spark, os.path.join(tmp, "in"), dst, as_of)
    weekly(spark, os.path.join(tmp, "in"), dst, "2024-01-17", force_monthly=True, before=steps.append)
    rep = os.path.join(dst, "reports")
    assert reports.read_report(spark, rep, "monthly_totals", "2024-01-17").first().weeks_covered == 2
    assert reports.read_report(spark, rep, "monthly_totals", "2024-01-31").first().weeks_covered == 4
    assert steps[:3] == ["ingest", "analysis", "snapshot"] and "metric_log" in steps and steps[-1] == "profile"


def test_reports_are_written_side_by_side(spark, tmp, monkeypatch):
    from pulsegrid.plans.analysis import run as weekly
    from test_ingest import HEART, days, put

    put(os.path.join(tmp, "in"), "subject=1.xml", *days(HEART, [60 + k % 5 for k in range(30)]))
    together, write, names = threading.Barrier(2), reports.write_report, []

    def waits(df, root, name, *args, **kwargs):
        names.append(name)
        if name in ("context", "chart_data"):
            together.wait(60)
        return write(df, root, name, *args, **kwargs)

    monkeypatch.setattr(reports, "write_report", waits)
    weekly(spark, os.path.join(tmp, "in"), os.path.join(tmp, "out"), "2024-01-31")
    assert len(names) == len(set(names)) == 12
    assert reports.read_report(spark, os.path.join(tmp, "out", "reports"), "chart_data").count() == 30
