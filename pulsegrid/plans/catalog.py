"""Registered queries: each operator of the inventory run on the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables.  Floating outputs that are not already rounded by the
operator's own rule are rounded to 4 digits (after clearing float noise at 6)
in the final projection only, so that summation order cannot change the
compared value.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.model import STAGE_COLUMNS, MetricDim
from pulsegrid.operators.anomaly import detect_anomalies
from pulsegrid.operators.correlate import (
    correlations, evening_workout_vs_sleep, intensity_vs_next_day_hrv, sleep_vs_next_day_rhr,
    temp_deviation_vs_rhr_change,
)
from pulsegrid.operators.sleep import sleep_nightly, sleep_rolling, sleep_stages, sleep_stats, stage_totals
from pulsegrid.operators.workout import workout_by_type, workout_stats, workout_weekly
from pulsegrid.operators.daily import daily_series, daily_values
from pulsegrid.operators.history import (
    build_snapshot, last_snapshots, monthly_due, monthly_rollup, monthly_totals, snapshot_history, wow_deltas,
)
from pulsegrid.operators.report import (
    context_text, date_range_of, metric_log, report_anomalies, report_overview, top_anomalies,
)
from pulsegrid.operators.typing import dataset_profile, dataset_totals, kept_skipped, type_records
from pulsegrid.plans.analysis import analysis_overview, analyze, output_checks
from pulsegrid.plans.ingest import ingest
from pulsegrid.operators.rolling import chart_data, rolling_baseline, rolling_means, series_stats
from pulsegrid.functions.timeparse import week_start
from pulsegrid.operators.trend import as_date, classify_trends, trend_summary
from pulsegrid.session import ensure_checkpoint_dir, materialize
from pulsegrid.sources.reports import read_report, write_report
from pulsegrid.sources.snapshots import load_snapshots, load_snapshots_json, save_snapshot, write_snapshots_json
from pulsegrid.sources.tables import read_records, read_workouts
from pulsegrid.plans.standin import (
    EVENTS_AS_OF, EVENTS_DIM, ORDERS_DIM, event_raw_records, event_records, order_records,
    sleep_records, table, workout_records,
)

SUM_EVENT_TYPES = sorted(m for m, a in EVENTS_DIM.agg.items() if a == "sum")


def _r4(c):
    """Report rounding of floats that have no rounding rule of their own."""
    return half_up(c, 4)


def event_daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_values(event_records(spark, sf), EVENTS_DIM)


def order_daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_values(order_records(spark, sf), ORDERS_DIM)


# -- step 1: daily series and anomalies ------------------------------------

def q_daily_mean(spark, sf):
    d = event_daily(spark, sf).where(~F.col("metric").isin(*SUM_EVENT_TYPES))
    return d.select("subject_id", "metric", "date", _r4("value").alias("value"))


def q_daily_sum_zero_filled(spark, sf):
    d = event_daily(spark, sf).where(F.col("metric").isin(*SUM_EVENT_TYPES))
    return d.select("subject_id", "metric", "date", _r4("value").alias("value"))


def q_anomalies(spark, sf):
    return detect_anomalies(event_daily(spark, sf))


def q_anomalies_long_history(spark, sf):
    return detect_anomalies(order_daily(spark, sf))


def q_anomaly_severity_counts(spark, sf):
    a = detect_anomalies(event_daily(spark, sf))
    return a.groupBy("metric", "severity").agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        half_up(F.avg("deviation_sigma"), 4).alias("mean_deviation"),
        F.max("deviation_sigma").alias("max_deviation"),
    )


# -- step 2: rolling frames and last-n ---------------------------------------

def _rolling_out(r):
    return r.select("subject_id", "metric", "date", _r4("raw").alias("raw"),
                    _r4("rolling_7").alias("rolling_7"), _r4("rolling_30").alias("rolling_30"),
                    _r4("rolling_90").alias("rolling_90"))


def q_rolling_7_30_90(spark, sf):
    return _rolling_out(rolling_means(event_daily(spark, sf)))


def q_rolling_long_history(spark, sf):
    return _rolling_out(rolling_means(order_daily(spark, sf)))


def q_baseline_deviation(spark, sf):
    b = rolling_baseline(event_daily(spark, sf))
    return b.select("subject_id", "metric", "date", _r4("value").alias("value"),
                    _r4("rolling_mean").alias("rolling_mean"),
                    _r4("baseline_deviation").alias("baseline_deviation"))


def q_last7_stats(spark, sf):
    st = series_stats(event_daily(spark, sf))
    return st.select("subject_id", "metric",
                     half_up(F.coalesce("avg_7d", "current"), 2).alias("avg"),
                     half_up("current", 2).alias("current"),
                     half_up("min_7d", 2).alias("min"),
                     half_up("max_7d", 2).alias("max"),
                     "n_points")


def q_chart_last90(spark, sf):
    c = chart_data(rolling_means(order_daily(spark, sf)))
    return c.select("subject_id", "metric", "date", _r4("raw").alias("raw"),
                    _r4("rolling_7").alias("rolling_7"))


# -- step 3: trends ----------------------------------------------------------

def q_trend_class(spark, sf):
    t = classify_trends(event_daily(spark, sf), EVENTS_DIM)
    return t.select("subject_id", "metric", "n_points", "n_trend", "trend_raw", "direction",
                    half_up(F.try_divide("slope_trend", F.nullif("std_trend", F.lit(0.0))), 4)
                    .alias("norm_slope"))


def event_trend_summary(spark, sf):
    daily = event_daily(spark, sf)
    return trend_summary(daily, detect_anomalies(daily), EVENTS_DIM, EVENTS_AS_OF)


def q_trend_summary(spark, sf):
    t = event_trend_summary(spark, sf)
    dates = F.transform("recent_anomalies", lambda a: F.date_format(a["date"], "yyyy-MM-dd"))
    return t.select("subject_id", "metric", "direction", "current_value", "avg_90d", "pct_vs_90d",
                    F.size("recent_anomalies").cast("bigint").alias("n_recent_anomalies"),
                    F.array_join(dates, ",").alias("recent_anomaly_dates"))


def q_recent_anomalies(spark, sf):
    t = event_trend_summary(spark, sf)
    return (t.select("subject_id", "metric", F.explode("recent_anomalies").alias("a"))
            .select("subject_id", "metric", "a.date", "a.value", "a.deviation_sigma", "a.severity"))


# -- step 4: sleep -------------------------------------------------------------

def event_sleep_totals(spark, sf):
    return stage_totals(sleep_records(spark, sf))


def q_sleep_nightly(spark, sf):
    n = sleep_nightly(event_sleep_totals(spark, sf))
    return n.select("subject_id", "night", _r4("hours").alias("hours"))


def q_sleep_stage_pivot(spark, sf):
    p = sleep_stages(event_sleep_totals(spark, sf))
    return p.select("subject_id", "night", *[_r4(c).alias(c) for c in STAGE_COLUMNS])


def q_sleep_rolling(spark, sf):
    r = sleep_rolling(sleep_nightly(event_sleep_totals(spark, sf)))
    return r.select("subject_id", "night", _r4("hours").alias("hours"),
                    _r4("avg_duration_7d").alias("avg_duration_7d"),
                    _r4("avg_duration_30d").alias("avg_duration_30d"))


def q_sleep_stats(spark, sf):
    return sleep_stats(sleep_nightly(event_sleep_totals(spark, sf)))


# -- step 5: workouts ------------------------------------------------------------

def q_workouts_by_type(spark, sf):
    return workout_by_type(workout_records(spark, sf))


def q_workout_weekly_load(spark, sf):
    return workout_weekly(workout_records(spark, sf))


def q_workout_stats(spark, sf):
    return workout_stats(workout_records(spark, sf))


# -- step 6: correlations ------------------------------------------------------------
# HRV, resting heart rate and temperature stand in as the daily means of
# signup, error and click events.

MEAN_DIM = MetricDim()
CORR_METRICS = ["signup", "error", "click"]


def _one_subject(df):
    return df.withColumn("subject_id", F.lit(0).cast("bigint"))


def _corr_daily(spark, sf, collapse=False):
    """Daily means of every correlation metric, one table: several series in
    one query are filters of it and share a single scan + shuffle."""
    recs = event_records(spark, sf, CORR_METRICS)
    if collapse:
        recs = _one_subject(recs)
    return daily_values(recs, MEAN_DIM)


def _series_of(daily, metric):
    return daily.where(F.col("metric") == metric).select("subject_id", "date", "value")


def _mean_series(spark, sf, metric, collapse=False):
    """One metric's daily means."""
    return _series_of(_corr_daily(spark, sf, collapse), metric)


def _sleep_series(spark, sf, collapse=False):
    recs = sleep_records(spark, sf)
    if collapse:
        recs = _one_subject(recs)
    return sleep_nightly(stage_totals(recs)).select(
        "subject_id", F.col("night").alias("date"), F.col("hours").alias("value"))


def _workouts(spark, sf, collapse=False):
    w = workout_records(spark, sf)
    return _one_subject(w) if collapse else w


def corr_intensity_next_day(spark, sf, collapse=False):
    return intensity_vs_next_day_hrv(_workouts(spark, sf, collapse),
                                     _mean_series(spark, sf, "signup", collapse))


def corr_sleep_next_day(spark, sf, collapse=False):
    return sleep_vs_next_day_rhr(_sleep_series(spark, sf, collapse),
                                 _mean_series(spark, sf, "error", collapse))


def corr_evening_sleep(spark, sf, collapse=False):
    return evening_workout_vs_sleep(_workouts(spark, sf, collapse), _sleep_series(spark, sf, collapse))


def corr_baseline_dev(spark, sf, collapse=False):
    daily = _corr_daily(spark, sf, collapse)
    return temp_deviation_vs_rhr_change(_series_of(daily, "click"), _series_of(daily, "error"))


def event_correlations(spark, sf, collapse=False):
    """C4 on the stand-in series: all four relations in one aligned pass."""
    daily = _corr_daily(spark, sf, collapse)
    return correlations(_workouts(spark, sf, collapse), _series_of(daily, "signup"),
                        _series_of(daily, "error"), _series_of(daily, "click"),
                        _sleep_series(spark, sf, collapse))


def q_corr_p_value(spark, sf):
    """All four relations with every user pooled into one subject (n ~ 30)."""
    return event_correlations(spark, sf, collapse=True)


# -- step 7: snapshot history ----------------------------------------------------------

def event_history(spark, sf, daily=None):
    """Weekly snapshots back-filled from the events stand-in, sleep included
    (``daily``: an already computed daily table to read instead)."""
    nightly = sleep_nightly(event_sleep_totals(spark, sf))
    if daily is None:
        daily = daily_series(event_records(spark, sf), EVENTS_DIM, nightly)
    return snapshot_history(daily, EVENTS_DIM, EVENTS_AS_OF,
                            workouts=workout_records(spark, sf), sleep_nightly=nightly)


def q_snapshot_metrics(spark, sf):
    return event_history(spark, sf)[0].drop("report_date")


def q_snapshot_runs(spark, sf):
    return event_history(spark, sf)[1].drop("report_date", "generated_at")


def q_wow_deltas(spark, sf):
    return wow_deltas(event_history(spark, sf)[0]).drop("report_date")


def q_monthly_rollup(spark, sf):
    return monthly_rollup(event_history(spark, sf)[0])


def q_monthly_totals(spark, sf):
    return monthly_totals(event_history(spark, sf)[1])


def q_monthly_due(spark, sf):
    return monthly_due(event_history(spark, sf)[1])


# -- step 8: report tables ------------------------------------------------------------

LOG_DATE = "2024-01-30"


def event_daily_with_sleep(spark, sf):
    """Daily series of every event metric plus the nightly sleep series."""
    nightly = sleep_nightly(event_sleep_totals(spark, sf))
    return daily_series(event_records(spark, sf), EVENTS_DIM, nightly)


def event_daily_table(spark, sf):
    """The daily table with sleep, written once under the shared checkpoint
    folder.  Composite queries read it in several branches that prune it
    differently, so Spark could not reuse one exchange for them: written
    once, every branch reads the same files instead of recomputing the raw
    aggregation (and a lost executor re-reads instead of recomputing)."""
    return materialize(event_daily_with_sleep(spark, sf), "events-daily")


def event_full_analysis(spark, sf, daily=None):
    """Daily series with sleep, its anomalies and trend summary."""
    if daily is None:
        daily = event_daily_with_sleep(spark, sf)
    anomalies = detect_anomalies(daily)
    trend = trend_summary(daily, anomalies, EVENTS_DIM, EVENTS_AS_OF)
    return daily, anomalies, trend


def q_report_overview(spark, sf):
    daily = event_daily_table(spark, sf)
    _, _, trend = event_full_analysis(spark, sf, daily)
    metric, _ = event_history(spark, sf, daily)
    wow = wow_deltas(last_snapshots(metric, 2)).where(F.col("week") == week_start(as_date(EVENTS_AS_OF)))
    return report_overview(trend, wow, EVENTS_DIM)


def q_report_anomalies(spark, sf):
    anomalies = detect_anomalies(event_daily_with_sleep(spark, sf))
    return report_anomalies(anomalies, EVENTS_AS_OF)


def q_top5_anomalies(spark, sf):
    anomalies = detect_anomalies(event_daily_with_sleep(spark, sf))
    return top_anomalies(anomalies, 5)


#: A series of this metric has no page before the upsert.
LOG_NEW_METRIC = "click"


def q_metric_log_upsert(spark, sf):
    """Two weekly runs on the same report date: the first creates the pages
    (history back-fill) but for one metric's, the second upserts the report
    date's row and back-fills the pages that are new."""
    daily, _, trend = event_full_analysis(spark, sf, event_daily_table(spark, sf))
    rolling = rolling_means(daily)
    first = metric_log(rolling, trend, EVENTS_DIM, LOG_DATE).where(F.col("metric") != LOG_NEW_METRIC)
    first = materialize(first, "events-metric-log")  # a later run reads a written log
    return metric_log(rolling, trend, EVENTS_DIM, LOG_DATE, existing=first)


def q_context_text(spark, sf):
    nightly = materialize(sleep_nightly(event_sleep_totals(spark, sf)), "events-nightly")
    daily = materialize(daily_series(event_records(spark, sf), EVENTS_DIM, nightly), "events-daily")
    _, anomalies, trend = event_full_analysis(spark, sf, daily)
    # click is summed in the daily table and averaged for the relations.
    means = _corr_daily(spark, sf)
    sleep_daily = nightly.select("subject_id", F.col("night").alias("date"), F.col("hours").alias("value"))
    corr = correlations(_workouts(spark, sf), _series_of(daily, "signup"), _series_of(daily, "error"),
                        _series_of(means, "click"), sleep_daily)
    return context_text(trend, anomalies, corr, date_range_of(daily))


# -- step 9: ingest, typing, profile ----------------------------------------------------

def q_dataset_profile(spark, sf):
    return dataset_profile(event_records(spark, sf))


def q_dataset_totals(spark, sf):
    return dataset_totals(event_records(spark, sf))


def q_kept_skipped_counts(spark, sf):
    return kept_skipped(event_raw_records(spark, sf), EVENTS_DIM)


def q_typed_records(spark, sf):
    t = type_records(event_raw_records(spark, sf), EVENTS_DIM)
    return t.select("subject_id", "metric", "value",
                    F.date_format("start_local", "yyyy-MM-dd HH:mm:ss").alias("start_local"),
                    F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_utc"))


# -- step 10: the whole analysis ---------------------------------------------------------

def event_analysis(spark, sf, materialize_daily=False):
    records = event_records(spark, sf).unionByName(sleep_records(spark, sf), allowMissingColumns=True)
    return analyze(records, workout_records(spark, sf), EVENTS_DIM, EVENTS_AS_OF,
                   materialize_daily=materialize_daily, hrv="signup", rhr="error", temp="click")


def q_full_analysis(spark, sf):
    return analysis_overview(event_analysis(spark, sf))


def q_analysis_outputs(spark, sf):
    """All 13 outputs of one analysis, each computed in full."""
    return output_checks(event_analysis(spark, sf, materialize_daily=True))


def q_build_snapshot(spark, sf):
    """The weekly snapshot from a finished analysis: metrics and run figures."""
    res = event_analysis(spark, sf, materialize_daily=True)
    metric, run = build_snapshot(res["trend"], res["anomalies"], res["workout_stats"], res["sleep_stats"], EVENTS_DIM,
                                 EVENTS_AS_OF, workout_weekly=res["workout_weekly"], generated_at="2024-01-31T00:00:00")
    return metric.join(run.drop("week"), ["subject_id", "report_date"])


# -- step 11: sinks and sources, written and read back -------------------------------------

def _folder(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "queries", f"{name}-{uuid.uuid4().hex}")


def q_snapshot_upsert(spark, sf):
    """Every week of the history saved out of order, every second one first, with
    figures that are off; then all saved again with the right ones."""
    metric, run = event_history(spark, sf)
    metric, run = materialize(metric, "history-metrics"), materialize(run, "history-runs")
    path = _folder(spark, "snapshots")
    weeks = sorted(r[0] for r in run.select("week").distinct().collect())
    for week in weeks[1::2] + weeks[0::2]:
        on = F.col("week") == F.lit(week)
        save_snapshot(spark, metric.where(on).withColumn("avg", F.col("avg") + 5.0), run.where(on), path)
    save_snapshot(spark, metric, run, path)
    stored, runs = load_snapshots(spark, path)
    return stored.join(runs.select("subject_id", "report_date", "run_number"), ["subject_id", "report_date"]) \
                 .select("subject_id", "report_date", "week", "metric", "avg", "run_number")


def q_snapshot_json_roundtrip(spark, sf):
    """The history as JSON documents, written in bundles and read back."""
    metric, run = event_history(spark, sf)
    path = _folder(spark, "json")
    write_snapshots_json(metric, run, path)
    metric, run = load_snapshots_json(spark, path)
    return metric.join(run.select("subject_id", "report_date", "run_number", "anomaly_count"), ["subject_id", "report_date"])


def _still_there(spark, sf):
    """The subjects with a reading on the last day of the data."""
    day = event_records(spark, sf).select("subject_id", F.to_date("start_local").alias("day"))
    last = day.agg(F.max("day").alias("day"))
    return day.join(last, "day").select("subject_id").distinct()


def q_report_sink_roundtrip(spark, sf):
    """A report written for two dates, the second again after some subjects
    left, and read back by date."""
    top = materialize(q_top5_anomalies(spark, sf), "top5")
    root = _folder(spark, "reports")
    write_report(top, root, "top", "2024-01-24", order_by=["subject_id"])
    write_report(top, root, "top", "2024-01-31", order_by=["subject_id"])
    write_report(top.join(_still_there(spark, sf), "subject_id", "left_semi"), root, "top", "2024-01-31", order_by=["subject_id"])
    return read_report(spark, root, "top").groupBy("report_date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"),
        F.sum("n_readings").alias("n_readings")).withColumn("report_date", F.col("report_date").cast("date"))


def write_exports(raw, folder):
    """Raw records as export XML: records and, for purchases, workouts as well.  A
    subject's export lies whole in one bundle; readings of nobody are in files of their own."""
    text = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;"))
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), text(c), F.lit('"'))
    whose = F.when(F.col("subject_id").isNotNull(), attribute("subject", F.col("subject_id").cast("string"))).otherwise(F.lit(""))
    record = F.concat(F.lit(" <Record"), whose, *[attribute(n, F.col(n)) for n in ("type", "sourceName", "unit", "value", "creationDate", "startDate")],
                      F.lit('/>'))
    workout = F.concat(F.lit(' <Workout'), whose, F.lit(' workoutActivityType="HKWorkoutActivityTypeOther"'), attribute("duration", F.col("value")),
                       attribute("startDate", F.col("startDate")), F.lit('/>'))
    both = F.when(F.col("type") == "Purchase", F.concat(record, F.lit("\n"), workout)).otherwise(record)
    bundle = F.when(F.col("subject_id").isNotNull(), "named").otherwise("unnamed")
    # By a hash of the subject, as a partitioning that ``raw`` happens to have may be split at run time.
    lines = raw.select("subject_id", bundle.alias("bundle"), both.alias("value")).repartition(F.xxhash64("subject_id"))
    lines.drop("subject_id").write.mode("append").partitionBy("bundle").text(folder)


def q_ingest_roundtrip(spark, sf):
    """Events as export XML, ingested, then one more ingest after new exports of
    the subjects that are still there, without their errors; the tables read back."""
    landing, tables = _folder(spark, "landing"), _folder(spark, "tables")
    raw = event_raw_records(spark, sf)
    write_exports(raw, os.path.join(landing, "1"))
    ingest(spark, landing, tables, dim=EVENTS_DIM, buckets=16)
    again = raw.where("type <> 'Error'").join(_still_there(spark, sf), "subject_id", "left_semi")
    write_exports(again, os.path.join(landing, "2"))
    ingest(spark, landing, tables, dim=EVENTS_DIM)
    return stored_totals(spark, tables)


def stored_totals(spark, tables):
    """Rows, sum, first and last start per subject and metric, workouts as one more metric."""
    records = read_records(spark, tables).select(
        "subject_id", "metric", "value", F.date_format("start_local", "yyyy-MM-dd HH:mm:ss").alias("start_local"))
    workouts = read_workouts(spark, tables).select(
        "subject_id", F.lit("workout").alias("metric"), F.col("duration").alias("value"),
        F.date_format("start_local", "yyyy-MM-dd HH:mm:ss").alias("start_local"))
    return records.unionByName(workouts).groupBy("subject_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), _r4(F.sum("value")).alias("total"), F.min("start_local").alias("first"),
        F.max("start_local").alias("last"))


def dirty_raw_records(spark, sf):
    """Events as raw text with the faults of real exports: missing and
    non-numeric values, bad dates, two offsets, days late."""
    ev = table(spark, sf, "events")
    k = F.col("event_id") % 11
    value = F.when(k == 0, F.lit(None)).when(k == 1, F.concat(F.floor("value").cast("string"), F.lit("d"))).when(k == 2, F.lit("")) \
             .when(k == 3, F.lit("nan")).when(k == 4, F.concat(F.floor("value").cast("string"), F.lit(".5e1"))).otherwise(F.col("value").cast("string"))
    offset = F.when(k % 2 == 0, F.lit(" -0600")).otherwise(F.lit(" +0230"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), offset)
    start = F.when(k == 5, F.lit("bad")).when(k == 6, F.lit(None)).otherwise(stamp)
    end = F.when(k.isin(5, 7), stamp)
    return ev.select(F.col("user_id").alias("subject_id"), F.initcap("event_type").alias("type"), F.lit("Watch").alias("sourceName"),
                     F.lit("count").alias("unit"), value.alias("value"), F.lit(None).cast("string").alias("creationDate"),
                     start.alias("startDate"), end.alias("endDate"))


def q_dirty_records(spark, sf):
    """Typing of faulty input: what is kept, what is missing, both clocks."""
    t = type_records(dirty_raw_records(spark, sf), EVENTS_DIM)
    return t.groupBy("subject_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), _r4(F.sum("value")).alias("total"),
        F.count("start_ts").alias("n_starts"), F.date_format(F.min("start_local"), "yyyy-MM-dd HH:mm:ss").alias("first_local"),
        F.date_format(F.max("start_ts"), "yyyy-MM-dd HH:mm:ss").alias("last_utc"))


def q_dirty_daily(spark, sf):
    """Daily series of faulty input: no day without a date, no mean without a value."""
    t = type_records(dirty_raw_records(spark, sf), EVENTS_DIM)
    return daily_values(t, EVENTS_DIM).select("subject_id", "metric", "date", _r4("value").alias("value"))


QUERIES = {
    "daily_mean": q_daily_mean,
    "daily_sum_zero_filled": q_daily_sum_zero_filled,
    "anomalies": q_anomalies,
    "anomalies_long_history": q_anomalies_long_history,
    "anomaly_severity_counts": q_anomaly_severity_counts,
    "rolling_7_30_90": q_rolling_7_30_90,
    "rolling_long_history": q_rolling_long_history,
    "baseline_deviation": q_baseline_deviation,
    "last7_stats": q_last7_stats,
    "chart_last90": q_chart_last90,
    "trend_class": q_trend_class,
    "trend_summary": q_trend_summary,
    "recent_anomalies": q_recent_anomalies,
    "sleep_nightly": q_sleep_nightly,
    "sleep_stage_pivot": q_sleep_stage_pivot,
    "sleep_rolling": q_sleep_rolling,
    "sleep_stats": q_sleep_stats,
    "workouts_by_type": q_workouts_by_type,
    "workout_weekly_load": q_workout_weekly_load,
    "workout_stats": q_workout_stats,
    "corr_intensity_next_day": corr_intensity_next_day,
    "corr_sleep_next_day": corr_sleep_next_day,
    "corr_evening_sleep": corr_evening_sleep,
    "corr_baseline_dev": corr_baseline_dev,
    "corr_p_value": q_corr_p_value,
    "snapshot_metrics": q_snapshot_metrics,
    "snapshot_runs": q_snapshot_runs,
    "wow_deltas": q_wow_deltas,
    "monthly_rollup": q_monthly_rollup,
    "monthly_totals": q_monthly_totals,
    "monthly_due": q_monthly_due,
    "report_overview": q_report_overview,
    "report_anomalies": q_report_anomalies,
    "top5_anomalies": q_top5_anomalies,
    "metric_log_upsert": q_metric_log_upsert,
    "context_text": q_context_text,
    "dataset_profile": q_dataset_profile,
    "dataset_totals": q_dataset_totals,
    "kept_skipped_counts": q_kept_skipped_counts,
    "typed_records": q_typed_records,
    "full_analysis": q_full_analysis,
    "analysis_outputs": q_analysis_outputs,
    "build_snapshot": q_build_snapshot,
    "snapshot_upsert": q_snapshot_upsert,
    "snapshot_json_roundtrip": q_snapshot_json_roundtrip,
    "report_sink_roundtrip": q_report_sink_roundtrip,
    "ingest_roundtrip": q_ingest_roundtrip,
    "dirty_records": q_dirty_records,
    "dirty_daily": q_dirty_daily,
}
