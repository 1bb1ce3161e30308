"""Workout analysis (C8: F6, F7, P6, P7, A8-A11, D15).

All three outputs are single partial-aggregated ``groupBy`` passes keyed by
subject (and activity or week), so a subject with a very large share of the
sessions is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import activity_name
from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.timeparse import week_start


def workout_duration(workouts: DataFrame):
    """Duration column by presence (duration > total_duration), else NULL."""
    for c in ("duration", "total_duration"):
        if c in workouts.columns:
            return F.col(c).cast("double")
    return F.lit(None).cast("double")


def workout_day(workouts: DataFrame):
    """P5: the start by presence (start_local > start_ts > date), else NULL."""
    for c in ("start_local", "start_ts", "date"):
        if c in workouts.columns:
            return F.col(c).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def _heart_rate(workouts: DataFrame):
    """The average heart rate column, when the table has one."""
    return F.col("average_heart_rate").cast("double") if "average_heart_rate" in workouts.columns else None


def _activity(workouts: DataFrame):
    for c in ("workout_activity_type", "type"):
        if c in workouts.columns:
            return activity_name(c)
    return None


def workout_by_type(workouts: DataFrame) -> DataFrame:
    """A8 + A9: sessions and mean duration (1 digit) per activity; every row
    counts, also those without a valid start."""
    act = _activity(workouts)
    if act is None:
        return workouts.sparkSession.createDataFrame(
            [], "subject_id bigint, activity string, sessions bigint, avg_duration_min double")
    return (workouts.select("subject_id", act.alias("activity"), workout_duration(workouts).alias("d"))
            .groupBy("subject_id", "activity")
            .agg(F.count(F.lit(1)).alias("sessions"), half_up(F.avg("d"), 1).alias("avg_duration_min")))


def workout_weekly(workouts: DataFrame) -> DataFrame:
    """A10: per Monday week: total minutes, sessions with a duration, mean heart
    rate (NULL without a heart-rate column, D15) and the load estimate
    total * avg_hr / 100 on the rounded inputs, or the total when no HR."""
    hr = _heart_rate(workouts)
    day = workout_day(workouts)
    rows = (workouts.where(day.isNotNull())
            .select("subject_id", week_start(day).alias("week"),
                    workout_duration(workouts).alias("d"),
                    (hr if hr is not None else F.lit(None).cast("double")).alias("hr")))
    weekly = rows.groupBy("subject_id", "week").agg(
        half_up(F.coalesce(F.sum("d"), F.lit(0.0)), 1).alias("total_duration_min"),
        F.count("d").alias("session_count"),
        half_up(F.avg("hr"), 1).alias("avg_hr"),
    )
    load = (half_up(F.col("total_duration_min") * F.col("avg_hr") / 100, 1) if hr is not None
            else F.col("total_duration_min"))
    return weekly.withColumn("estimated_load", load)


def workout_stats(workouts: DataFrame) -> DataFrame:
    """Sessions with a valid start, total hours (1 digit), mean minutes
    (NULL when no duration), distinct activities."""
    act = _activity(workouts)
    rows = workouts.where(workout_day(workouts).isNotNull()).select(
        "subject_id", workout_duration(workouts).alias("d"),
        (act if act is not None else F.lit(None).cast("string")).alias("activity"))
    return rows.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_workouts"),
        half_up(F.coalesce(F.sum("d"), F.lit(0.0)) / 60, 1).alias("total_duration_hrs"),
        half_up(F.avg("d"), 1).alias("avg_duration_min"),
        F.count_distinct("activity").alias("unique_types"),
    )


def daily_intensity(workouts: DataFrame, evening_hour: int | None = None) -> DataFrame:
    """A3 / A4: mean workout intensity per (subject, day): heart rate when the
    table has it, else duration (P6); with ``evening_hour`` only sessions
    starting at or after that hour (P8)."""
    hr = _heart_rate(workouts)
    intensity = hr if hr is not None else workout_duration(workouts)
    start = workout_day(workouts)
    rows = workouts.where(start.isNotNull())
    if evening_hour is not None:
        rows = rows.where(F.hour(start) >= evening_hour)
    return (rows.select("subject_id", F.to_date(start).alias("date"), intensity.alias("x"))
            .groupBy("subject_id", "date").agg(F.avg("x").alias("value")))
