"""Full analysis (C9) and the weekly run (C14).

``analyze`` returns a dict of lazy DataFrames.  The daily table feeds the
rolling, anomaly, trend and correlation branches; anomalies and the trend
summary feed the snapshot and four report tables.  With ``materialize_daily``
these three are each written once to the shared checkpoint folder, so every
consumer reads one computed table (and a lost executor re-reads files instead
of recomputing the raw aggregation and the window passes), as do those of the
nightly sleep.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.model import ANOMALY_THRESHOLD, ROLLING_WINDOWS, SLEEP_METRIC, MetricDim
from pulsegrid.operators.anomaly import detect_anomalies
from pulsegrid.operators.correlate import correlations
from pulsegrid.operators.daily import daily_series
from pulsegrid.operators.history import (
    build_snapshot, last_snapshots, monthly_due, monthly_rollup, monthly_totals, wow_deltas,
)
from pulsegrid.operators.report import (
    context_text, date_range_of, metric_log_rows, report_anomalies, report_overview, top_anomalies,
)
from pulsegrid.operators.rolling import chart_data, rolling_means
from pulsegrid.operators.sleep import sleep_nightly, sleep_rolling, sleep_stages, sleep_stats, stage_totals
from pulsegrid.operators.trend import as_date, trend_summary
from pulsegrid.operators.typing import dataset_profile
from pulsegrid.operators.workout import workout_by_type, workout_stats, workout_weekly
from pulsegrid.session import materialize, scratch_tables

#: Reports that a run writes side by side: the tail of one's tasks and the planning
#: of the next leave cores idle.
REPORTS_AT_ONCE = 4

# Metric names used by the correlation relations (C4).
HRV, RHR, TEMP = "hrv", "resting_heart_rate", "wrist_temperature"


def analyze(records: DataFrame, workouts: DataFrame, dim: MetricDim, as_of,
            materialize_daily: bool = False, hrv: str = HRV, rhr: str = RHR,
            temp: str = TEMP, threshold: float = ANOMALY_THRESHOLD,
            windows: tuple[int, ...] = ROLLING_WINDOWS) -> dict[str, DataFrame]:
    """Every analysis output of one run, lazily.  ``hrv``/``rhr``/``temp``
    name the metrics the correlation relations use; ``threshold`` and
    ``windows`` are the job parameters of anomalies and rolling means (S13)."""
    totals = stage_totals(records.where(F.col("metric") == SLEEP_METRIC))
    nightly = sleep_nightly(totals)
    if materialize_daily:
        nightly = materialize(nightly, "nightly")
    daily = daily_series(records, dim, nightly)
    if materialize_daily:
        daily = materialize(daily, "daily")
    rolling = rolling_means(daily, windows)
    anomalies = detect_anomalies(daily, threshold)
    if materialize_daily:
        anomalies = materialize(anomalies, "anomalies")
    trend = trend_summary(daily, anomalies, dim, as_of)
    if materialize_daily:
        trend = materialize(trend, "trend")

    def series(metric):
        return daily.where(F.col("metric") == metric).select("subject_id", "date", "value")

    sleep_daily = nightly.select("subject_id", F.col("night").alias("date"), F.col("hours").alias("value"))
    out = {
        "daily": daily,
        "rolling": rolling,
        "anomalies": anomalies,
        "trend": trend,
        "correlations": correlations(workouts, series(hrv), series(rhr), series(temp), sleep_daily),
        "sleep_nightly": nightly,
        "sleep_stages": sleep_stages(totals),
        "sleep_rolling": sleep_rolling(nightly),
        "sleep_stats": sleep_stats(nightly),
        "workout_by_type": workout_by_type(workouts),
        "workout_weekly": workout_weekly(workouts),
        "workout_stats": workout_stats(workouts),
    }
    if 7 in windows:  # the chart shows the 7-row mean
        out["chart"] = chart_data(rolling)
    return out


def analysis_overview(result: dict[str, DataFrame]) -> DataFrame:
    """One row per subject summarising a run (series, anomalies, nights, workouts)."""
    series = result["daily"].groupBy("subject_id").agg(
        F.count_distinct("metric").alias("n_series"), F.count(F.lit(1)).alias("n_daily_rows"))
    anoms = result["anomalies"].groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_anomalies"))
    nights = result["sleep_stats"].select("subject_id", "total_nights", "mean_hrs")
    works = result["workout_stats"].select("subject_id", "total_workouts")
    out = (series.join(anoms, "subject_id", "left").join(nights, "subject_id", "left")
           .join(works, "subject_id", "left"))
    return out.select("subject_id", "n_series", "n_daily_rows",
                      F.coalesce("n_anomalies", F.lit(0)).cast("bigint").alias("n_anomalies"),
                      F.coalesce("total_nights", F.lit(0)).cast("bigint").alias("total_nights"),
                      "mean_hrs",
                      F.coalesce("total_workouts", F.lit(0)).cast("bigint").alias("total_workouts"))


#: K2-K4: the presentation order of each report, kept inside its files ("-": descending).
REPORT_ORDER = {
    "overview": ["subject_id", "metric"], "anomalies": ["subject_id", "row_no"], "top_anomalies": ["subject_id", "metric", "k"],
    "workouts_by_type": ["subject_id", "-sessions", "activity"], "workout_weekly": ["subject_id", "week"],
    "sleep_nightly": ["subject_id", "night"], "sleep_stats": ["subject_id"], "chart_data": ["subject_id", "metric", "date"],
    "context": ["subject_id"], "monthly_metrics": ["subject_id", "metric"], "monthly_totals": ["subject_id"], "profile": ["metric"],
}

#: Of each output, the columns that a checksum adds up (rounded figures).
CHECKED = {
    "daily": ["value"], "rolling": ["raw", "rolling_7", "rolling_30", "rolling_90"], "chart": ["raw", "rolling_7"],
    "anomalies": ["value", "deviation_sigma"], "trend": ["current_value", "avg_90d", "pct_vs_90d"], "correlations": ["r", "p"],
    "sleep_nightly": ["hours"], "sleep_stages": ["asleep_unspecified", "core", "deep", "rem", "unknown"],
    "sleep_rolling": ["hours", "avg_duration_7d", "avg_duration_30d"], "sleep_stats": ["mean_hrs", "median_hrs", "total_nights"],
    "workout_by_type": ["sessions", "avg_duration_min"], "workout_weekly": ["total_duration_min", "session_count"],
    "workout_stats": ["total_workouts", "total_duration_hrs", "avg_duration_min", "unique_types"],
}


def output_checks(result: dict[str, DataFrame], checked: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per output of a run: its rows, its figures that are present, and
    the sum of its figures in hundredths (each rounded first, to 4 digits and
    then 2, so the sum is exact).  For comparing runs: every output is computed."""
    def one(name: str, columns: list[str]) -> DataFrame:
        hundredths = [F.round(half_up(half_up(F.col(c).cast("double"), 4), 2) * 100).cast("bigint") for c in columns]
        return result[name].agg(
            F.lit(name).alias("output"), F.count(F.lit(1)).alias("n_rows"),
            sum((F.count(c) for c in columns), F.lit(0)).cast("bigint").alias("n_figures"),
            sum((F.coalesce(F.sum(h), F.lit(0)) for h in hundredths), F.lit(0)).cast("bigint").alias("hundredths"))

    return reduce(DataFrame.unionByName, [one(n, c) for n, c in (checked or CHECKED).items()])


def run(spark: SparkSession, src: str, dst: str, as_of, dim: MetricDim | None = None,
        force: bool = False, force_monthly: bool = False, subject: int | None = None,
        category_codes: dict | None = None, threshold: float = ANOMALY_THRESHOLD,
        windows: tuple[int, ...] = ROLLING_WINDOWS, hrv: str = HRV, rhr: str = RHR, temp: str = TEMP,
        before: Callable[[str], None] | None = None) -> dict:
    """C14: ingest -> analyze -> snapshot upsert -> week-over-week -> monthly -> reports.

    ``subject``, ``category_codes``: as in ``ingest``; ``threshold``,
    ``windows``, ``hrv``, ``rhr``, ``temp``: as in ``analyze``.  ``before`` is told the
    name of each step (ingest, analysis, snapshot, each report) as it begins, for
    progress.  A run for an earlier date compares with the runs up to that date.
    Intermediate tables go at the end of the run.  Reports are written
    ``REPORTS_AT_ONCE`` at a time; those before the metric log are done when it begins.
    """
    with scratch_tables(spark):
        return _run(spark, src, dst, as_of, dim or MetricDim.health(), force, force_monthly, subject, category_codes,
                    {"threshold": threshold, "windows": windows, "hrv": hrv, "rhr": rhr, "temp": temp}, before or (lambda step: None))


def _run(spark, src, dst, as_of, dim, force, force_monthly, subject, category_codes, options, before) -> dict:
    from pulsegrid.plans.ingest import ingest
    from pulsegrid.sources.reports import read_metric_pages, write_metric_log, write_report
    from pulsegrid.sources.snapshots import load_snapshots, save_snapshot
    from pulsegrid.sources.tables import read_records, read_workouts

    tables = os.path.join(dst, "tables")
    before("ingest")
    counts = ingest(spark, src, tables, force=force, dim=dim, subject=subject, category_codes=category_codes)
    before("analysis")
    records, workouts = read_records(spark, tables), read_workouts(spark, tables)
    res = analyze(records, workouts, dim, as_of, materialize_daily=True, **options)

    before("snapshot")
    snapshots = os.path.join(dst, "snapshots")
    metric, run_rows = build_snapshot(res["trend"], res["anomalies"], res["workout_stats"], res["sleep_stats"], dim, as_of,
                                      workout_weekly=res["workout_weekly"])
    save_snapshot(spark, metric, run_rows, snapshots)
    upto = F.col("report_date") <= as_date(as_of)
    hist_metric, hist_run = (stored.where(upto) for stored in load_snapshots(spark, snapshots))
    # Subjects without this run have no change to report; two runs are enough.
    wow_now = wow_deltas(last_snapshots(hist_metric, 2)).where(F.col("report_date") == as_date(as_of))

    reports = os.path.join(dst, "reports")

    def write_all(todo: list[tuple[str, Callable[[], object]]]) -> None:
        with ThreadPoolExecutor(REPORTS_AT_ONCE) as pool:
            begun = []
            for name, job in todo:
                before(name)
                begun.append(pool.submit(inheritable_thread_target(spark)(job)))
        for job in begun:
            job.result()

    def report(df: DataFrame, name: str) -> tuple[str, Callable[[], object]]:
        return name, lambda: write_report(df, reports, name, as_of, order_by=REPORT_ORDER.get(name))

    # The long ones first.
    todo = [report(context_text(res["trend"], res["anomalies"], res["correlations"], date_range_of(res["daily"])), "context")]
    if "chart" in res:
        todo.append(report(res["chart"], "chart_data"))
    write_all(todo + [
        report(report_overview(res["trend"], wow_now, dim), "overview"),
        report(report_anomalies(res["anomalies"], as_of, threshold=options["threshold"]), "anomalies"),
        report(top_anomalies(res["anomalies"]), "top_anomalies"),
        report(res["workout_by_type"], "workouts_by_type"),
        report(res["workout_weekly"], "workout_weekly"),
        report(res["sleep_nightly"], "sleep_nightly"),
        report(res["sleep_stats"], "sleep_stats"),
    ])
    log = metric_log_rows(res["rolling"], res["trend"], dim, as_of, read_metric_pages(spark, reports))
    due = monthly_due(hist_run)
    if force_monthly:
        due = due.withColumn("monthly_due", F.lit(True))
    due_subjects = due.where("monthly_due").select("subject_id")
    write_all([
        ("metric_log", lambda: write_metric_log(spark, log, reports, as_of)),
        report(monthly_rollup(hist_metric).join(due_subjects, "subject_id", "left_semi"), "monthly_metrics"),
        report(monthly_totals(hist_run).join(due_subjects, "subject_id", "left_semi"), "monthly_totals"),
        report(dataset_profile(records), "profile"),
    ])
    return counts
