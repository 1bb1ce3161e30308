"""Row-based rolling frames and last-n summaries.

Every frame is ROW based -- ``rowsBetween(-(n-1), 0)`` -- and carries its
own minimum-count gate evaluated over the same frame.  All windows share the
(subject_id, metric) partitioning the daily table already has, so Catalyst
plans them without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.model import (
    ANOMALY_MIN_PERIODS, ANOMALY_WINDOW, ROLLING_WINDOWS, SERIES_KEY, TREND_WINDOW,
)


def series_window(keys=None):
    return Window.partitionBy(*(keys or SERIES_KEY)).orderBy("date")


def gated_mean(value: str, n: int, min_periods: int, keys=None):
    frame = series_window(keys).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= min_periods, F.avg(value).over(frame))


def rolling_means(daily: DataFrame, windows=ROLLING_WINDOWS, keys=None) -> DataFrame:
    """``raw`` plus ``rolling_<n>`` with min periods max(1, n // 3)."""
    keys = keys or SERIES_KEY
    cols = [gated_mean("value", n, max(1, n // 3), keys).alias(f"rolling_{n}") for n in windows]
    return daily.select(*keys, "date", F.col("value").alias("raw"), *cols)


def rolling_baseline(daily: DataFrame, window: int = ANOMALY_WINDOW,
                     min_periods: int = ANOMALY_MIN_PERIODS, keys=None) -> DataFrame:
    """W2 + W3 + W12: rolling mean / sample std over ``window`` rows (gated on
    ``min_periods``), the deviation from that baseline and the series size."""
    keys = keys or SERIES_KEY
    frame = series_window(keys).rowsBetween(-(window - 1), 0)
    enough = F.count("value").over(frame) >= min_periods
    return daily.select(
        *keys, "date", "value",
        F.when(enough, F.avg("value").over(frame)).alias("rolling_mean"),
        F.when(enough, F.stddev_samp("value").over(frame)).alias("rolling_std"),
        F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("series_points"),
    ).withColumn("baseline_deviation", F.col("value") - F.col("rolling_mean"))


def series_stats(daily: DataFrame, trend_window: int = TREND_WINDOW, keys=None) -> DataFrame:
    """One pass per series: a single descending ``row_number`` feeds every
    last-n figure as a conditional aggregate (W5, W6, W8, A13, A14, A15).

    Columns: n_points, first_date, last_date, current, avg_7d, min_7d, max_7d,
    avg_90d, n_trend, slope_trend, std_trend.  The trend slope regresses the
    last ``trend_window`` values on -rn, which differs from position 0..n-1 by
    a constant shift and so has the same slope.
    """
    keys = keys or SERIES_KEY
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    # Daily rows never carry a NULL value (A1 drops empty days, A2 fills 0.0),
    # so no filter here: the plan stays identical to the other branches over
    # the same daily table and Spark reuses its exchange.
    ranked = daily.select(*keys, "date", "value", rn.alias("rn"))
    v = F.col("value")
    last = lambda n: F.when(F.col("rn") <= n, v)
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.max_by(v, F.col("date")).alias("current"),
        F.avg(last(7)).alias("avg_7d"),
        F.min(last(7)).alias("min_7d"),
        F.max(last(7)).alias("max_7d"),
        F.avg(last(90)).alias("avg_90d"),
        F.count(last(trend_window)).alias("n_trend"),
        F.regr_slope(last(trend_window), -F.col("rn").cast("double")).alias("slope_trend"),
        F.stddev_pop(last(trend_window)).alias("std_trend"),
    )


def last_n_rows(frame: DataFrame, n: int, keys=None) -> DataFrame:
    """The last ``n`` rows of every series (planned as a WindowGroupLimit)."""
    keys = keys or SERIES_KEY
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    return frame.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")


def chart_data(rolling: DataFrame, n: int = 90, min_points: int = 2, keys=None) -> DataFrame:
    """K8: last ``n`` points of raw and rolling_7 for series with >= ``min_points`` rows.
    Places are counted from the start against the series' size, so the sort of the
    rolling means serves this and a report in order of dates."""
    keys = keys or SERIES_KEY
    size, k = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(series_window(keys))
    placed = rolling.select(*keys, "date", "raw", "rolling_7", k.alias("_k"), size.alias("_n"))
    return placed.where((F.col("_k") > F.col("_n") - n) & (F.least("_n", F.lit(n)) >= min_points)).drop("_k", "_n")
