import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import D0, daily_df, sleep_df, workouts_df
from pulsegrid.model import MetricDim
from pulsegrid.operators.history import (
    monthly_due, monthly_rollup, monthly_totals, snapshot_history, wow_deltas,
)
from pulsegrid.sources.snapshots import load_snapshots, load_snapshots_json, save_snapshot, to_json_documents, write_snapshots_json

MS = "subject_id bigint, report_date date, week date, metric string, avg double, current double, min double, max double, " \
     "avg_90d double, direction string, unit string"
RS = "subject_id bigint, report_date date, week date, generated_at string, run_number bigint, anomaly_count bigint, " \
     "workout_count bigint, workout_duration_hrs double, workouts_in_week bigint, sleep_avg_hrs double"


def W(k):
    return D0 + dt.timedelta(days=7 * k)


def _metric(spark, rows):
    return spark.createDataFrame([(s, W(k), W(k), m, a, a, a, a, a, "stable", "u") for s, k, m, a in rows], MS)


def _runs(spark, rows):
    return spark.createDataFrame([(s, W(k), W(k), "t", k + 1, a, w, h, None, sl) for s, k, a, w, h, sl in rows], RS)


def _unnumbered(spark, rows):
    return _runs(spark, rows).drop("run_number")


def test_wow_rules(spark):
    metric = _metric(spark, [(1, 0, "a", 10.0), (1, 1, "a", 10.009), (1, 0, "b", 0.0), (1, 1, "b", 5.0),
                             (1, 0, "c", 3.0), (1, 1, "c", 3.01), (1, 1, "only_now", 1.0),
                             (1, 0, "gap", 1.0), (1, 2, "gap", 2.0)])
    got = {r.metric: r for r in wow_deltas(metric).collect()}
    assert set(got) == {"a", "b", "c"}                     # missing / non-consecutive skipped
    assert (got["a"].delta, got["a"].direction) == (0.01, "up")
    assert (got["b"].pct_change, got["b"].direction) == (0.0, "up")    # previous 0 -> 0.0
    assert (got["c"].delta, got["c"].pct_change, got["c"].direction) == (0.01, 0.3, "up")
    m2 = _metric(spark, [(1, 0, "a", 10.0), (1, 1, "a", 10.004)])
    assert wow_deltas(m2).first().direction == "unchanged"


@pytest.mark.parametrize("n_runs,covered", [(1, None), (2, 2), (4, 4), (5, 4)])
def test_monthly_gates(spark, n_runs, covered):
    runs = _runs(spark, [(1, k, 1, 2, 1.5, 7.0 + k) for k in range(n_runs)])
    metric = _metric(spark, [(1, k, "a", float(k)) for k in range(n_runs)])
    tot = monthly_totals(runs).collect()
    roll = monthly_rollup(metric).collect()
    if covered is None:
        assert tot == [] and roll == []
        return
    t = tot[0]
    assert (t.weeks_covered, t.total_anomalies, t.total_workouts) == (covered, covered, 2 * covered)
    assert t.total_workout_hrs == round(1.5 * covered, 1)
    ks = list(range(n_runs))[-covered:]
    assert roll[0].month_avg == round(sum(ks) / covered, 2)
    assert (roll[0].best_week, roll[0].worst_week) == (float(max(ks)), float(min(ks)))


def test_monthly_due(spark):
    due = {r.subject_id: r.monthly_due for r in monthly_due(_runs(spark, [(1, k, 0, 0, 0.0, None) for k in range(4)]
                                                                       + [(2, k, 0, 0, 0.0, None) for k in range(5)])).collect()}
    assert due == {1: True, 2: False}


def test_snapshot_upsert_keeps_run_number_and_other_subjects(spark, tmp):
    path = os.path.join(tmp, "snap")
    m = lambda s, k, a: _metric(spark, [(s, k, "a", a)])
    r = lambda s, k: _unnumbered(spark, [(s, k, 1, 2, 3.0, 7.0)])
    save_snapshot(spark, m(1, 0, 1.0), r(1, 0), path)
    save_snapshot(spark, m(2, 0, 5.0), r(2, 0), path)
    save_snapshot(spark, m(1, 1, 2.0), r(1, 1), path)
    save_snapshot(spark, m(1, 1, 3.0), r(1, 1), path)     # same week again: update in place
    metric, runs = load_snapshots(spark, path)
    got = sorted((x.subject_id, x.week, x.run_number) for x in runs.collect())
    assert got == [(1, W(0), 1), (1, W(1), 2), (2, W(0), 1)]
    avgs = sorted((x.subject_id, x.week, x.avg) for x in metric.collect())
    assert avgs == [(1, W(0), 1.0), (1, W(1), 3.0), (2, W(0), 5.0)]


def test_load_json_history(spark, tmp):
    doc = [{"week": "2024-01-07", "generated_at": "x", "run_number": 1,
            "metrics": {"hrv": {"avg": 50.1, "current": 49.0, "min": 45.0, "max": 55.0, "avg_90d": 48.0,
                                "direction": "improving", "unit": "ms"}},
            "anomaly_count": 2, "workout_count": 3, "workout_duration_hrs": 1.5, "sleep_avg_hrs": None}]
    p = os.path.join(tmp, "subject=9")
    os.makedirs(p)
    with open(os.path.join(p, "weekly_snapshots.json"), "w") as f:
        json.dump(doc, f)
    metric, runs = load_snapshots_json(spark, p)
    r = runs.first()
    assert (r.subject_id, r.report_date, r.run_number, r.anomaly_count) == (9, dt.date(2024, 1, 7), 1, 2)
    assert (r.week, r.generated_at) == (dt.date(2024, 1, 1), "x")
    mm = metric.first()
    assert (mm.metric, mm.avg, mm.direction) == ("hrv", 50.1, "improving")
    docs = to_json_documents(metric, runs).first()
    assert docs.metrics["hrv"].unit == "ms" and (docs.week, docs.generated_at) == ("2024-01-07", "x")
    empty_m, empty_r = load_snapshots_json(spark, os.path.join(tmp, "missing"))
    assert empty_r.count() == 0


def test_history_backfill_carries_forward(spark):
    # series "a" has data in weeks 0 and 2 only; week 1 repeats week 0's figures.
    daily = daily_df(spark, {"a": [(0, 1.0), (1, 3.0), (14, 10.0)]})
    metric, runs = snapshot_history(daily, MetricDim(), W(3))
    got = {r.week: (r.avg, r.current, r.min, r.max) for r in metric.collect()}
    assert got == {W(0): (2.0, 3.0, 1.0, 3.0), W(1): (2.0, 3.0, 1.0, 3.0),
                   W(2): (4.67, 10.0, 1.0, 10.0), W(3): (4.67, 10.0, 1.0, 10.0)}
    assert sorted((r.week, r.run_number) for r in runs.collect()) == [(W(k), k + 1) for k in range(4)]


def test_history_run_totals_asof(spark):
    daily = daily_df(spark, {"a": [(d, 1.0) for d in range(21)]})
    wk = workouts_df(spark, [(1, "HKWorkoutActivityTypeRunning", 60, "2024-01-02 07:00:00"),
                             (1, "HKWorkoutActivityTypeRunning", 30, "2024-01-16 07:00:00")])
    nightly = spark.createDataFrame([(1, W(0), 6.0), (1, W(1), 8.0)], "subject_id bigint, night date, hours double")
    _, runs = snapshot_history(daily, MetricDim(), W(2), workouts=wk, sleep_nightly=nightly)
    got = {r.week: (r.workout_count, r.workout_duration_hrs, r.sleep_avg_hrs) for r in runs.collect()}
    assert got == {W(0): (1, 1.0, 6.0), W(1): (1, 1.0, 7.0), W(2): (2, 1.5, 7.0)}


def test_backfill_last_week_equals_weekly_snapshot(spark):
    """The two snapshot paths agree: the back-filled figures of the last week
    equal the snapshot built from a trend summary over all the data."""
    import random
    from pulsegrid.operators.anomaly import detect_anomalies
    from pulsegrid.operators.history import build_snapshot
    from pulsegrid.operators.trend import trend_summary
    rnd = random.Random(5)
    dim = MetricDim(polarity={"a": "higher", "b": "lower"}, unit={"a": "u"})
    series = {m: [(d, rnd.uniform(0, 50) + (d if m == "a" else -d)) for d in range(70) if rnd.random() < 0.8]
              for m in ("a", "b", "c")}
    daily = daily_df(spark, series)
    as_of = D0 + dt.timedelta(days=69)
    hist, _ = snapshot_history(daily, dim, as_of)
    last = {r.metric: r for r in hist.where(F.col("week") == F.lit(str(W(9))).cast("date")).collect()}
    anoms = detect_anomalies(daily)
    ws = spark.createDataFrame([], "subject_id bigint, total_workouts bigint, total_duration_hrs double")
    ss = spark.createDataFrame([], "subject_id bigint, mean_hrs double")
    snap, _ = build_snapshot(trend_summary(daily, anoms, dim, as_of), anoms, ws, ss, dim, as_of)
    for r in snap.collect():
        h = last[r.metric]
        assert (r.avg, r.current, r.min, r.max, r.avg_90d, r.direction, r.unit) == \
               (h.avg, h.current, h.min, h.max, h.avg_90d, h.direction, h.unit)


def test_snapshot_upsert_is_idempotent(spark, tmp):
    """Re-running a failed or repeated weekly save leaves the store unchanged."""
    path = os.path.join(tmp, "snap")
    metric = _metric(spark, [(1, 0, "a", 1.0), (1, 0, "b", 2.0), (2, 0, "a", 4.0)])
    run = _unnumbered(spark, [(1, 0, 1, 2, 3.0, 7.0), (2, 0, 0, 0, 0.0, None)])
    save_snapshot(spark, _metric(spark, [(1, 1, "a", 9.0)]), _unnumbered(spark, [(1, 1, 0, 0, 0.0, None)]), path)

    def state():
        m, r = load_snapshots(spark, path)
        return sorted(map(tuple, m.collect())), sorted(map(tuple, r.collect()))

    save_snapshot(spark, metric, run, path)
    once = state()
    save_snapshot(spark, metric, run, path)
    assert state() == once
    metrics, stored = load_snapshots(spark, path)
    assert {(x.subject_id, x.week): x.run_number for x in stored.collect()} == {(1, W(1)): 1, (1, W(0)): 2, (2, W(0)): 1}
    # The earlier week was saved later: it is still the one before.
    delta = wow_deltas(metrics).collect()
    assert [(d.subject_id, d.week, d.metric, d.delta) for d in delta] == [(1, W(1), "a", 8.0)]


def test_two_report_dates_of_one_week_are_two_runs(spark, tmp):
    path = os.path.join(tmp, "snap")
    for day, avg in ((1, 1.0), (3, 4.0)):
        date = F.lit(D0 + dt.timedelta(days=day))
        save_snapshot(spark, _metric(spark, [(1, 0, "a", avg)]).withColumn("report_date", date),
                      _unnumbered(spark, [(1, 0, 0, 0, 0.0, None)]).withColumn("report_date", date), path)
    metric, runs = load_snapshots(spark, path)
    assert sorted(r.run_number for r in runs.collect()) == [1, 2] and {r.week for r in runs.collect()} == {W(0)}
    assert [d.delta for d in wow_deltas(metric).collect()] == [3.0]


def test_json_history_round_trip(spark, tmp):
    path = os.path.join(tmp, "json")
    metric = _metric(spark, [(s, k, m, float(k)) for s in (1, 22) for k in range(3) for m in ("a", "b")])
    runs = _runs(spark, [(s, k, k, 0, 0.5, None) for s in (1, 22) for k in range(3)])
    write_snapshots_json(metric, runs, path)
    back_m, back_r = load_snapshots_json(spark, path)
    assert sorted(map(tuple, back_m.select(*metric.columns).collect())) == sorted(map(tuple, metric.collect()))
    assert sorted(map(str, back_r.select(*runs.columns).collect())) == sorted(map(str, runs.collect()))


def test_metric_log_back_fills_each_new_page(spark, tmp):
    from pulsegrid.operators.report import metric_log_rows
    from pulsegrid.operators.rolling import rolling_means
    from pulsegrid.operators.trend import classify_trends
    from pulsegrid.sources.reports import read_metric_log, write_metric_log

    dim = MetricDim()
    first = daily_df(spark, {"a": [(d, float(d)) for d in range(20)]})
    both = first.unionByName(daily_df(spark, {"b": [(d, 1.0 + d) for d in range(20)]})) \
        .unionByName(daily_df(spark, {"a": [(d, 2.0 + d) for d in range(20)]}, subject=2))

    def save(daily, day):
        trend = classify_trends(daily, dim).withColumn("current_value", F.col("current"))
        write_metric_log(spark, metric_log_rows(rolling_means(daily), trend, dim, D0 + dt.timedelta(days=day), read_metric_log(spark, tmp)), tmp)
        return {(r.subject_id, r.metric): r["count"] for r in read_metric_log(spark, tmp).groupBy("subject_id", "metric").count().collect()}

    assert save(first, 25) == {(1, "a"): 20}
    assert save(both, 30) == {(1, "a"): 21, (1, "b"): 20, (2, "a"): 20}
    assert save(both, 30) == {(1, "a"): 21, (1, "b"): 21, (2, "a"): 21}
