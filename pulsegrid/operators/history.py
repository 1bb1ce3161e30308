"""Snapshot history, week-over-week deltas and monthly rollups.

Tables
  snapshot_metric(subject_id, report_date, week, metric, avg, current, min, max, avg_90d,
                  direction, unit)
  snapshot_run(subject_id, report_date, week, generated_at, run_number, anomaly_count,
               workout_count, workout_duration_hrs, workouts_in_week, sleep_avg_hrs)

The key is the report date; ``week`` is its Monday, for reports by week.  A
subject's runs are ordered by report date, whatever order they were saved in.
A back-filled snapshot describes the data as of the end of its week, its Sunday.
``build_snapshot`` makes the snapshot of one
report date from a finished analysis (the weekly job); ``snapshot_history``
back-fills the snapshots of every week from the daily table in one pass.

Scale.  The back-fill is a single (subject_id, metric) window pass over the
daily table (already partitioned that way): framed aggregates give the
as-of figures of every day, the last day of each week is kept, and weeks
without data inherit the previous week's figures through ``lead`` +
``sequence`` -- no calendar spine join and no range join.  Run-level totals
(workouts, sleep) are merged as-of with a union + ``last(ignorenulls)``
window per subject over weekly rows, which are bounded by the number of
weeks however many readings a subject has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import polarity_label, trend_class, wow_direction
from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.timeparse import week_start
from pulsegrid.model import (
    ANOMALY_MIN_PERIODS, ANOMALY_MIN_POINTS, ANOMALY_THRESHOLD, ANOMALY_WINDOW,
    MONTHLY_SNAPSHOTS, SERIES_KEY, TREND_WINDOW, MetricDim,
)
from pulsegrid.operators.trend import as_date
from pulsegrid.operators.workout import workout_day, workout_duration



def _week_step():
    return F.expr("INTERVAL 7 DAYS")


# -- one report date (the weekly job) -------------------------------------------

def build_snapshot(trend: DataFrame, anomalies: DataFrame, workout_stats: DataFrame,
                   sleep_stats: DataFrame, dim: MetricDim, report_date,
                   workout_weekly: DataFrame | None = None, generated_at: str | None = None):
    """The snapshot of one report date from a finished analysis.

    ``trend`` is the output of ``trend_summary``.  Returns
    (snapshot_metric, snapshot_run) without ``run_number`` (assigned on save).
    ``workout_weekly`` (A10) gives ``workouts_in_week`` (D7), null without it;
    ``generated_at`` is ISO text, by default the time of the run.
    """
    day = as_date(report_date)
    week = week_start(day)
    metric = trend.select(
        "subject_id", day.alias("report_date"), week.alias("week"), "metric",
        half_up(F.coalesce("avg_7d", "current"), 2).alias("avg"),
        F.col("current_value").alias("current"),
        half_up("min_7d", 2).alias("min"), half_up("max_7d", 2).alias("max"),
        "avg_90d", "direction", dim.unit_expr(F.col("metric")).alias("unit"))
    counts = anomalies.groupBy("subject_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
    subjects = trend.select("subject_id").distinct()
    if workout_weekly is None:
        subjects = subjects.withColumn("workouts_in_week", F.lit(None).cast("bigint"))
    else:
        own = workout_weekly.where(F.col("week") == week).select("subject_id", F.col("session_count").alias("workouts_in_week"))
        subjects = subjects.join(own, "subject_id", "left").fillna(0, ["workouts_in_week"])
    stamp = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    run = (subjects.join(counts, "subject_id", "left")
           .join(workout_stats.select("subject_id", "total_workouts", "total_duration_hrs"),
                 "subject_id", "left")
           .join(sleep_stats.select("subject_id", "mean_hrs"), "subject_id", "left")
           .select("subject_id", day.alias("report_date"), week.alias("week"), stamp.alias("generated_at"),
                   F.coalesce("anomaly_count", F.lit(0)).cast("bigint").alias("anomaly_count"),
                   F.coalesce("total_workouts", F.lit(0)).cast("bigint").alias("workout_count"),
                   F.coalesce("total_duration_hrs", F.lit(0.0)).alias("workout_duration_hrs"), "workouts_in_week",
                   F.col("mean_hrs").alias("sleep_avg_hrs")))
    return metric, run


# -- back-filled history -------------------------------------------------------------

def _asof_daily(daily: DataFrame, threshold: float, trend_window: int) -> DataFrame:
    """Every daily row with the figures a report on that day would show."""
    w = Window.partitionBy(*SERIES_KEY).orderBy("date")
    pos = daily.select(*SERIES_KEY, "date", "value", F.row_number().over(w).alias("pos"))
    f7, f30, f90 = (w.rowsBetween(-(n - 1), 0) for n in (7, trend_window, 90))
    fa = w.rowsBetween(-(ANOMALY_WINDOW - 1), 0)
    v = F.col("value")
    cnt_a = F.count(v).over(fa)
    mu, sd = F.avg(v).over(fa), F.stddev_samp(v).over(fa)
    flagged = ((cnt_a >= ANOMALY_MIN_PERIODS) & sd.isNotNull() & (sd != 0)
               & (F.try_divide(F.abs(v - mu), sd) >= threshold))
    stats = pos.select(
        *SERIES_KEY, "date", "value", "pos",
        F.avg(v).over(f7).alias("avg7"), F.min(v).over(f7).alias("min7"), F.max(v).over(f7).alias("max7"),
        F.avg(v).over(f90).alias("avg90"),
        F.count(v).over(f30).alias("n_trend"),
        F.regr_slope(v, F.col("pos").cast("double")).over(f30).alias("slope"),
        F.stddev_pop(v).over(f30).alias("sd_trend"),
        F.coalesce(flagged, F.lit(False)).cast("int").alias("flag"),
        F.lead("date").over(w).alias("next_date"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return stats.withColumn("flags_so_far", F.sum("flag").over(running))


def snapshot_history(daily: DataFrame, dim: MetricDim, last_week, *, workouts: DataFrame | None = None,
                     sleep_nightly: DataFrame | None = None, threshold: float = ANOMALY_THRESHOLD,
                     trend_window: int = TREND_WINDOW, min_points: int = ANOMALY_MIN_POINTS):
    """Back-fill (snapshot_metric, snapshot_run) for every week from each
    series' first week through ``last_week`` (a date; its Monday is used)."""
    last = week_start(as_date(last_week))
    rows = _asof_daily(daily, threshold, trend_window).withColumn("week", week_start("date"))
    week_last = rows.where(F.col("next_date").isNull() | (week_start("next_date") != F.col("week")))
    week_last = week_last.where(F.col("week") <= last)
    ww = Window.partitionBy(*SERIES_KEY).orderBy("week")
    owned_until = F.coalesce(F.date_sub(F.lead("week").over(ww), 7), last)
    carried = (week_last.withColumn("_until", owned_until)
               .select("*", F.explode(F.sequence("week", "_until", _week_step())).alias("snap_week")))
    raw = trend_class("n_trend", "slope", "sd_trend")
    metric = carried.select(
        "subject_id", F.date_add("snap_week", 6).alias("report_date"), F.col("snap_week").alias("week"), "metric",
        half_up("avg7", 2).alias("avg"), half_up("value", 2).alias("current"),
        half_up("min7", 2).alias("min"), half_up("max7", 2).alias("max"),
        half_up("avg90", 2).alias("avg_90d"),
        polarity_label(raw, dim.polarity_expr(F.col("metric"))).alias("direction"),
        dim.unit_expr(F.col("metric")).alias("unit"),
        F.when(F.col("pos") >= min_points, F.col("flags_so_far")).otherwise(0).alias("_anoms"),
    )
    per_week = metric.groupBy("subject_id", "week").agg(F.sum("_anoms").cast("bigint").alias("anomaly_count"))
    run = _run_totals(per_week, workouts, sleep_nightly)
    return metric.drop("_anoms"), run


def _run_totals(per_week: DataFrame, workouts: DataFrame | None, sleep_nightly: DataFrame | None) -> DataFrame:
    """As-of merge of cumulative workout and sleep totals onto the report weeks."""
    parts = [per_week.select("subject_id", "week", F.lit(1).alias("kind"), "anomaly_count",
                             *[F.lit(None).cast(t).alias(c) for c, t in
                               (("w_n", "bigint"), ("w_min", "double"), ("s_n", "bigint"), ("s_h", "double"))])]
    day = workout_day(workouts) if workouts is not None else None
    if workouts is not None:
        wk = (workouts.where(day.isNotNull())
              .groupBy("subject_id", week_start(day).alias("week"))
              .agg(F.count(F.lit(1)).alias("w_n"), F.sum(workout_duration(workouts)).alias("w_min")))
        parts.append(wk.select("subject_id", "week", F.lit(0).alias("kind"),
                               F.lit(None).cast("bigint").alias("anomaly_count"), "w_n", "w_min",
                               F.lit(None).cast("bigint").alias("s_n"), F.lit(None).cast("double").alias("s_h")))
    if sleep_nightly is not None:
        sk = (sleep_nightly.groupBy("subject_id", week_start("night").alias("week"))
              .agg(F.count(F.lit(1)).alias("s_n"), F.sum("hours").alias("s_h")))
        parts.append(sk.select("subject_id", "week", F.lit(0).alias("kind"),
                               F.lit(None).cast("bigint").alias("anomaly_count"),
                               F.lit(None).cast("bigint").alias("w_n"), F.lit(None).cast("double").alias("w_min"),
                               "s_n", "s_h"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    upto = Window.partitionBy("subject_id").orderBy("week", "kind").rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.select(
        "subject_id", "week", "kind", "anomaly_count", F.col("w_n").alias("w_own"),
        F.sum("w_n").over(upto).alias("w_n"), F.sum("w_min").over(upto).alias("w_min"),
        F.sum("s_n").over(upto).alias("s_n"), F.sum("s_h").over(upto).alias("s_h"))
    of_week = F.max("w_own").over(Window.partitionBy("subject_id", "week"))
    runs = cum.withColumn("workouts_in_week", F.coalesce(of_week, F.lit(0))).where(F.col("kind") == 1)
    rn = F.row_number().over(Window.partitionBy("subject_id").orderBy("week"))
    return runs.select(
        "subject_id", F.date_add("week", 6).alias("report_date"), "week", F.lit(None).cast("string").alias("generated_at"),
        rn.cast("bigint").alias("run_number"), "anomaly_count",
        F.coalesce("w_n", F.lit(0)).cast("bigint").alias("workout_count"),
        half_up(F.coalesce("w_min", F.lit(0.0)) / 60, 1).alias("workout_duration_hrs"),
        F.col("workouts_in_week").cast("bigint").alias("workouts_in_week"),
        half_up(F.try_divide("s_h", "s_n"), 2).alias("sleep_avg_hrs"))


# -- comparisons over the history ---------------------------------------------------

def _run_position(newest_first: bool = False):
    """Place of a row's run among the subject's runs that have metrics."""
    order = F.desc("report_date") if newest_first else F.col("report_date")
    return F.dense_rank().over(Window.partitionBy("subject_id").orderBy(order))


def wow_deltas(metric: DataFrame) -> DataFrame:
    """Each snapshot metric against the same metric in the
    subject's run before it by report date (both must exist); delta and percent
    rounded as reported (percent from the rounded delta, 0.0 when the previous
    is 0).  Runs are numbered in the pass over the metrics themselves: one
    shuffle by subject, no join."""
    m = metric.withColumn("_run", _run_position()).where(F.col("avg").isNotNull())
    w = Window.partitionBy(*SERIES_KEY).orderBy("report_date")
    prev = m.select("*", F.lag("avg").over(w).alias("previous_avg"), F.lag("_run").over(w).alias("_prev"))
    paired = prev.where(F.col("_prev") == F.col("_run") - 1)
    delta = half_up(F.col("avg") - F.col("previous_avg"), 2)
    pct = F.when(F.col("previous_avg") == 0, F.lit(0.0)).otherwise(
        half_up(F.try_divide(delta, F.col("previous_avg")) * 100, 1))
    return paired.select("subject_id", "report_date", "week", "metric", delta.alias("delta"), pct.alias("pct_change"),
                         wow_direction(delta).alias("direction"), "unit",
                         F.col("avg").alias("current_avg"), "previous_avg")


def last_snapshots(metric: DataFrame, n: int) -> DataFrame:
    """The metrics of each subject's last ``n`` runs."""
    return metric.withColumn("_back", _run_position(newest_first=True)).where(F.col("_back") <= n).drop("_back")


def last_runs(run: DataFrame, n: int = MONTHLY_SNAPSHOTS) -> DataFrame:
    """K6: each subject's last ``n`` runs by report date (all when fewer) with
    the count covered."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("report_date"))
    return (run.select("*", F.row_number().over(w).alias("_k"),
                       F.count(F.lit(1)).over(Window.partitionBy("subject_id")).alias("_runs"))
            .where(F.col("_k") <= n)
            .withColumn("weeks_covered", F.least(F.col("_runs"), F.lit(n)).cast("bigint"))
            .drop("_k", "_runs"))


def monthly_rollup(metric: DataFrame, n: int = MONTHLY_SNAPSHOTS, min_runs: int = 2) -> DataFrame:
    """Month average, best (max) and worst (min) weekly average per
    metric over the last ``n`` runs, for subjects with >= ``min_runs`` runs."""
    back = metric.withColumn("_back", _run_position(newest_first=True))
    runs = F.max("_back").over(Window.partitionBy("subject_id"))
    m = back.withColumn("_runs", runs).where((F.col("_back") <= n) & (F.col("_runs") >= min_runs) & F.col("avg").isNotNull())
    return m.groupBy("subject_id", "metric").agg(
        half_up(F.avg("avg"), 2).alias("month_avg"),
        half_up(F.max("avg"), 2).alias("best_week"),
        half_up(F.min("avg"), 2).alias("worst_week"),
        F.first("unit").alias("unit"))


def monthly_totals(run: DataFrame, n: int = MONTHLY_SNAPSHOTS, min_runs: int = 2) -> DataFrame:
    """A18 + A19 (D7: all-time counts per snapshot are summed, as reported)."""
    recent = last_runs(run, n).where(F.col("weeks_covered") >= min_runs)
    return recent.groupBy("subject_id").agg(
        F.max("weeks_covered").alias("weeks_covered"),
        F.sum("anomaly_count").cast("bigint").alias("total_anomalies"),
        F.sum("workout_count").cast("bigint").alias("total_workouts"),
        half_up(F.sum("workout_duration_hrs"), 1).alias("total_workout_hrs"),
        half_up(F.avg("sleep_avg_hrs"), 2).alias("avg_sleep_hrs"))


def monthly_due(run: DataFrame) -> DataFrame:
    """Is the latest run a multiple of 4."""
    latest = run.groupBy("subject_id").agg(F.max("run_number").alias("latest_run"))
    return latest.withColumn("monthly_due", (F.col("latest_run") % 4) == 0)
