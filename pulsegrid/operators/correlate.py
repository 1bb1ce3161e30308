"""Correlations between daily series (C4: J1-J5, W7, A12, U1).

Each relation pairs two *daily* series on (subject_id, date) -- a
calendar-shifted key for the next-day relations, never ``lag`` (days may be
missing).  The pairing is the inner equi-join on date, planned as a union of
both tagged sides and one (subject, relationship, date) aggregation; all
four relations share that aggregation and the per-(subject, relationship)
reduction that follows, so C4 costs two partially aggregated shuffles in
total.  Inputs are already one row per subject and day, so every group is
bounded by the calendar regardless of how many readings a subject has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.stats import pearson_r, with_p_value
from pulsegrid.model import (
    ANOMALY_MIN_PERIODS, ANOMALY_WINDOW, CORR_MIN_PAIRS, EVENING_HOUR,
)
from pulsegrid.operators.rolling import gated_mean
from pulsegrid.operators.workout import daily_intensity


def shift_days(series: DataFrame, days: int) -> DataFrame:
    """Move a daily series ``days`` calendar days earlier (d+1 -> d)."""
    return series.withColumn("date", F.date_sub("date", days))


def relation_sides(x: DataFrame, y: DataFrame, relationship: str) -> DataFrame:
    """Both daily series of one relation as tagged rows
    (subject_id, relationship, date, x, y, in_x, in_y)."""
    none = F.lit(None).cast("double")
    rel = F.lit(relationship).alias("relationship")
    a = x.select("subject_id", rel, "date", F.col("value").alias("x"), none.alias("y"),
                 F.lit(True).alias("in_x"), F.lit(False).alias("in_y"))
    b = y.select("subject_id", rel, "date", none.alias("x"), F.col("value").alias("y"),
                 F.lit(False).alias("in_x"), F.lit(True).alias("in_y"))
    return a.unionByName(b)


def pearson_table(sides: DataFrame, min_pairs: int = CORR_MIN_PAIRS) -> DataFrame:
    """J1 + A12 + U1 for any number of relations at once: per (subject,
    relationship) r (4 digits), two-sided p (6 digits) and n pairs.

    A subject gets a row when both input series have rows (the relation
    exists, even with no aligned non-null pair); with fewer than
    ``min_pairs`` aligned days r and p are NULL.

    Plan: the tagged sides of every relation are aligned by one
    (subject, relationship, date) aggregation -- the inner equi-join on date
    -- and reduced by one (subject, relationship) aggregation; both run with
    partial aggregation, no join.  A group holds one subject's days of one
    relation, bounded by the calendar however many readings it has.
    """
    keys = ["subject_id", "relationship"]
    aligned = (sides.groupBy(*keys, "date")
               .agg(F.max("x").alias("x"), F.max("y").alias("y"),
                    F.bool_or("in_x").alias("in_x"), F.bool_or("in_y").alias("in_y")))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.when(both, F.col("x")), F.when(both, F.col("y"))
    stats = (aligned.groupBy(*keys)
             .agg(F.count_if(both).alias("n"), pearson_r(px, py).alias("r_raw"),
                  F.bool_or("in_x").alias("in_x"), F.bool_or("in_y").alias("in_y"))
             .where(F.col("in_x") & F.col("in_y"))
             .select(*keys, F.col("n").cast("bigint").alias("n"),
                     F.when(F.col("n") >= min_pairs, F.col("r_raw")).alias("r_raw")))
    out = with_p_value(stats, "r_raw", "n", "p_raw")
    return out.select(*keys, half_up("r_raw", 4).alias("r"), half_up("p_raw", 6).alias("p"), "n")


def pearson(x: DataFrame, y: DataFrame, relationship: str,
            min_pairs: int = CORR_MIN_PAIRS) -> DataFrame:
    """One relation: ``pearson_table`` over the sides of ``x`` and ``y``."""
    return pearson_table(relation_sides(x, y, relationship), min_pairs)


def baseline_change(series: DataFrame, window: int = ANOMALY_WINDOW,
                    min_periods: int = ANOMALY_MIN_PERIODS) -> DataFrame:
    """W3 on one metric: value minus its own rolling mean (NULL until gated)."""
    keys = ["subject_id"]
    return series.select("subject_id", "date",
                         (F.col("value") - gated_mean("value", window, min_periods, keys)).alias("value"))


REL_INTENSITY_HRV = "workout_intensity_vs_next_day_hrv"
REL_SLEEP_RHR = "sleep_duration_vs_next_day_rhr"
REL_EVENING_SLEEP = "evening_workout_vs_sleep_quality"
REL_TEMP_RHR = "wrist_temp_deviation_vs_rhr_change"


def intensity_hrv_sides(workouts: DataFrame, hrv: DataFrame) -> DataFrame:
    """Workout intensity on day d vs HRV on d+1."""
    return relation_sides(daily_intensity(workouts), shift_days(hrv, 1), REL_INTENSITY_HRV)


def sleep_rhr_sides(sleep_daily: DataFrame, rhr: DataFrame) -> DataFrame:
    """Hours slept on night d vs resting heart rate on d+1 (the morning after)."""
    return relation_sides(sleep_daily, shift_days(rhr, 1), REL_SLEEP_RHR)


def evening_sleep_sides(workouts: DataFrame, sleep_daily: DataFrame,
                        evening_hour: int = EVENING_HOUR) -> DataFrame:
    """Mean intensity of sessions starting >= 18:00 on d vs sleep of night d."""
    return relation_sides(daily_intensity(workouts, evening_hour), sleep_daily, REL_EVENING_SLEEP)


def temp_rhr_sides(temp: DataFrame, rhr: DataFrame) -> DataFrame:
    """Each series' deviation from its own 30-row baseline, same date."""
    return relation_sides(baseline_change(temp), baseline_change(rhr), REL_TEMP_RHR)


def intensity_vs_next_day_hrv(workouts: DataFrame, hrv: DataFrame) -> DataFrame:
    return pearson_table(intensity_hrv_sides(workouts, hrv))


def sleep_vs_next_day_rhr(sleep_daily: DataFrame, rhr: DataFrame) -> DataFrame:
    return pearson_table(sleep_rhr_sides(sleep_daily, rhr))


def evening_workout_vs_sleep(workouts: DataFrame, sleep_daily: DataFrame,
                             evening_hour: int = EVENING_HOUR) -> DataFrame:
    return pearson_table(evening_sleep_sides(workouts, sleep_daily, evening_hour))


def temp_deviation_vs_rhr_change(temp: DataFrame, rhr: DataFrame) -> DataFrame:
    return pearson_table(temp_rhr_sides(temp, rhr))


def correlations(workouts: DataFrame, hrv: DataFrame, rhr: DataFrame, temp: DataFrame,
                 sleep_daily: DataFrame) -> DataFrame:
    """C4: all four relations as one long table (subject_id, relationship, r, p, n),
    aligned and reduced in one pass (two aggregations for all four)."""
    sides = (intensity_hrv_sides(workouts, hrv)
             .unionByName(sleep_rhr_sides(sleep_daily, rhr))
             .unionByName(evening_sleep_sides(workouts, sleep_daily))
             .unionByName(temp_rhr_sides(temp, rhr)))
    return pearson_table(sides)
