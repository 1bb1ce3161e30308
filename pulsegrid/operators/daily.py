"""Daily series.

``daily(subject_id, metric, date, value)`` is the core time-series table:

* mean metrics: the day's mean; days without a value are absent;
* cumulative (sum) metrics: the day's sum, and every day between a series'
  first and last day is present, missing days as 0.0.

Scale notes.  The per-day ``groupBy`` runs with partial (map-side)
aggregation, so a subject holding a third of all readings is reduced to at
most one row per (metric, day) before anything is shuffled.  Gap filling
then uses ``lead`` over the (subject, metric) window -- no calendar spine
join -- and leaves the table hash-partitioned by (subject_id, metric), which
every later window (rolling, baseline, trend) reuses without another
exchange.  Window partitions hold one row per calendar day, so they stay
small however many readings a subject has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.timeparse import day
from pulsegrid.model import SERIES_KEY, SKIP_METRICS, MetricDim


# P5: the date column is chosen by presence, not per row.
DATE_PRIORITY = ["date", "start_local", "creation_local", "creation_ts"]


def pick_date_column(df: DataFrame) -> str | None:
    return next((c for c in DATE_PRIORITY if c in df.columns), None)


def _per_day(records: DataFrame, dim: MetricDim, date_col: str | None, skip: list[str] | None) -> DataFrame | None:
    """A1/A2 before gap filling: (subject_id, metric, date, value, is_sum)."""
    skip = SKIP_METRICS if skip is None else skip
    date_col = date_col or pick_date_column(records)
    if date_col is None:
        return None
    # Keys are filtered explicitly: joins downstream would otherwise infer
    # these filters on one branch only and the branches over this table
    # could no longer share its scan and shuffle.
    rows = (records
            .where(F.col("subject_id").isNotNull() & F.col("metric").isNotNull()
                   & F.col(date_col).isNotNull() & ~F.col("metric").isin(*skip))
            .select("subject_id", "metric", day(date_col).alias("date"), "value"))
    per_day = (rows
               .groupBy("subject_id", "metric", "date")
               .agg(F.avg("value").alias("mean_v"), F.sum("value").alias("sum_v")))
    is_sum = dim.is_sum(F.col("metric"))
    value = F.when(is_sum, F.coalesce("sum_v", F.lit(0.0))).otherwise(F.col("mean_v"))
    return (per_day
            .select("subject_id", "metric", "date", value.alias("value"), is_sum.alias("is_sum"))
            .where(F.col("is_sum") | F.col("value").isNotNull()))


def _gap_fill(per_day: DataFrame) -> DataFrame:
    """J11 as a gap fill: each sum-day owns the missing days up to the next one."""
    w = Window.partitionBy(*SERIES_KEY).orderBy("date")
    last_owned = F.when(F.col("is_sum"), F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date"))) \
        .otherwise(F.col("date"))
    return (per_day
            .select("subject_id", "metric", "date", "value", last_owned.alias("last_owned"))
            .select("subject_id", "metric", "value",
                    F.posexplode(F.sequence("date", "last_owned")).alias("pos", "day"))
            .select("subject_id", "metric", F.col("day").alias("date"),
                    F.when(F.col("pos") == 0, F.col("value")).otherwise(F.lit(0.0)).alias("value")))


def _empty_daily(records: DataFrame) -> DataFrame:
    return records.sparkSession.createDataFrame([], "subject_id bigint, metric string, date date, value double")


def daily_values(records: DataFrame, dim: MetricDim, date_col: str | None = None,
                 skip: list[str] | None = None) -> DataFrame:
    """A1 + A2 over a long ``records`` table (subject_id, metric, <date>, value).

    The date column is ``date_col`` or, by presence, date > start > creation
    (P5): a NULL start does not fall back to the creation date.
    """
    per_day = _per_day(records, dim, date_col, skip)
    return _empty_daily(records) if per_day is None else _gap_fill(per_day)


def daily_series(records: DataFrame, dim: MetricDim, sleep_nightly: DataFrame | None = None,
                 date_col: str | None = None) -> DataFrame:
    """Every metric's daily series plus the derived ``sleep_duration``.

    The nightly sleep series joins the per-day rows *before* the gap-fill
    window (as a mean-type series it is never filled), so one
    (subject_id, metric) exchange serves the gap fill and every later window;
    a union after the window would lose that partitioning and shuffle all
    daily rows again.
    """
    per_day = _per_day(records, dim, date_col, None)
    if sleep_nightly is not None:
        sleep = sleep_nightly.select("subject_id", F.lit("sleep_duration").alias("metric"),
                                     F.col("night").alias("date"), F.col("hours").alias("value"),
                                     F.lit(False).alias("is_sum"))
        per_day = sleep if per_day is None else per_day.unionByName(sleep)
    return _empty_daily(records) if per_day is None else _gap_fill(per_day)


def daily_from_totals(days: DataFrame, dim: MetricDim) -> DataFrame:
    """A1 + A2 + J11 from per-day totals (subject_id, metric, date, total,
    n_values), as a stream keeps them: the same table as ``daily_values`` gives
    from the readings."""
    is_sum = dim.is_sum(F.col("metric"))
    value = F.when(is_sum, F.coalesce("total", F.lit(0.0))).otherwise(F.try_divide("total", "n_values"))
    rows = days.select(*SERIES_KEY, "date", value.alias("value"), is_sum.alias("is_sum"))
    return _gap_fill(rows.where(F.col("is_sum") | F.col("value").isNotNull()))
