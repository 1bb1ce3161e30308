"""Sleep analysis (C7: F4, F5, F8, P9, P10, A5, A6, A7, W4).

Plan.  Raw intervals are reduced first -- one partial-aggregated ``groupBy``
to (subject, night, code) -- and every later step (the per-subject
``has_stages`` flag, the exclusion of in-bed/awake time, the nightly total,
the stage pivot) runs on that reduced table, whose size per subject is
bounded by nights x codes.  A subject holding a third of all intervals
therefore never lands whole in one task; the flag is never collected to the
driver or broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import sleep_stage
from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.timeparse import duration_hours, night_of
from pulsegrid.model import NIGHT_CUTOFF_HOUR, SLEEP_EXCLUDED, STAGE_COLUMNS
from pulsegrid.operators.rolling import gated_mean


def stage_totals(sleep: DataFrame, cutoff_hour: int = NIGHT_CUTOFF_HOUR) -> DataFrame:
    """(subject_id, night, code, stage, hours, has_stages) -- partial-aggregated.

    ``sleep`` has subject_id, value (the category code), start_local,
    start_ts, end_ts.  Rows with an unknown night are kept here because they
    still count towards ``has_stages`` (more than 2 distinct non-null codes
    over *all* of a subject's intervals); they are dropped downstream.
    """
    rows = sleep.select(
        "subject_id",
        night_of("start_local", cutoff_hour).alias("night"),
        F.col("value").alias("code"),
        duration_hours("start_ts", "end_ts").alias("hrs"),
    )
    per_code = rows.groupBy("subject_id", "night", "code").agg(F.sum("hrs").alias("hours"))
    n_codes = F.size(F.collect_set("code").over(Window.partitionBy("subject_id")))
    return per_code.select("subject_id", "night", "code", sleep_stage("code").alias("stage"), "hours",
                           (n_codes > 2).alias("has_stages"))


def _asleep(totals: DataFrame) -> DataFrame:
    return totals.where(F.col("night").isNotNull()
                        & (~F.col("has_stages") | ~F.col("stage").isin(*SLEEP_EXCLUDED)))


def sleep_nightly(totals: DataFrame) -> DataFrame:
    """A5: hours of sleep per (subject, night); overlaps are not merged."""
    return (_asleep(totals).groupBy("subject_id", "night")
            .agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours")))


def sleep_stages(totals: DataFrame) -> DataFrame:
    """Night x stage minutes, one column per stage (fixed list), 0 when absent.
    Only subjects with stage data have rows."""
    staged = _asleep(totals).where("has_stages")
    return (staged.groupBy("subject_id", "night")
            .pivot("stage", STAGE_COLUMNS)
            .agg(F.sum(F.col("hours") * 60))
            .na.fill(0.0, subset=STAGE_COLUMNS))


def sleep_rolling(nightly: DataFrame) -> DataFrame:
    """7-night mean (min 3) and 30-night mean (min 7), row based."""
    d = nightly.select("subject_id", F.col("night").alias("date"), F.col("hours").alias("value"))
    keys = ["subject_id"]
    return d.select("subject_id", F.col("date").alias("night"), F.col("value").alias("hours"),
                    gated_mean("value", 7, 3, keys).alias("avg_duration_7d"),
                    gated_mean("value", 30, 7, keys).alias("avg_duration_30d"))


def sleep_stats(nightly: DataFrame) -> DataFrame:
    """Mean, median, sample std, min, max (2 digits) and number of nights."""
    h = F.col("hours")
    return nightly.groupBy("subject_id").agg(
        half_up(F.avg(h), 2).alias("mean_hrs"),
        half_up(F.median(h), 2).alias("median_hrs"),
        half_up(F.stddev_samp(h), 2).alias("std_hrs"),
        half_up(F.min(h), 2).alias("min_hrs"),
        half_up(F.max(h), 2).alias("max_hrs"),
        F.count(F.lit(1)).alias("total_nights"),
    )
