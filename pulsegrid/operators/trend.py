"""Trend summary (C6: A13, F11, F12, F13, J6, N3, P14)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.labels import polarity_label, trend_class
from pulsegrid.model import RECENT_ANOMALY_DAYS, SERIES_KEY, MetricDim
from pulsegrid.operators.rolling import series_stats


def as_date(value) -> Column:
    """A report date given as text, ``datetime.date`` or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.date):
        value = value.isoformat()
    return F.to_date(F.lit(value))


def classify_trends(daily: DataFrame, dim: MetricDim) -> DataFrame:
    """Per series: raw class (F11) and polarity-aware direction (F12) plus the
    current / 90-point figures (A14, F13)."""
    st = series_stats(daily)
    raw = trend_class(F.col("n_trend"), F.col("slope_trend"), F.col("std_trend"))
    avg90 = F.col("avg_90d")
    pct = half_up(F.try_divide(F.col("current") - avg90, F.nullif(avg90, F.lit(0.0))) * 100, 1)
    return st.select(
        *SERIES_KEY, "n_points", "n_trend", "slope_trend", "std_trend",
        raw.alias("trend_raw"),
        polarity_label(raw, dim.polarity_expr(F.col("metric"))).alias("direction"),
        "current", "avg_90d", "avg_7d", "min_7d", "max_7d", "last_date",
        pct.alias("pct_vs_90d"),
    )


def recent_anomaly_lists(anomalies: DataFrame, as_of, days: int = RECENT_ANOMALY_DAYS) -> DataFrame:
    """Per series, anomalies dated from ``as_of - days`` on, newest
    first, nested as an array of structs.  No upper bound (P14, as P15): the
    report date is the end of the data."""
    cutoff = F.date_sub(as_date(as_of), days)
    entry = F.struct("date", "value", "rolling_mean", "rolling_std", "expected_low",
                     "expected_high", "deviation_sigma", "severity")
    return (anomalies.where(F.col("date") >= cutoff)
            .groupBy(*SERIES_KEY)
            .agg(F.sort_array(F.collect_list(entry), asc=False).alias("recent_anomalies")))


def trend_summary(daily: DataFrame, anomalies: DataFrame, dim: MetricDim, as_of,
                  recent_days: int = RECENT_ANOMALY_DAYS) -> DataFrame:
    """Direction, current value, 90-point mean, percent vs it, recent anomalies."""
    trends = classify_trends(daily, dim)
    recent = recent_anomaly_lists(anomalies, as_of, recent_days)
    empty = F.array().cast(recent.schema["recent_anomalies"].dataType)
    return (trends.join(recent, SERIES_KEY, "left")
            .select(*SERIES_KEY, "direction",
                    half_up("current", 2).alias("current_value"),
                    half_up("avg_90d", 2).alias("avg_90d"),
                    "pct_vs_90d",
                    F.coalesce("recent_anomalies", empty).alias("recent_anomalies"),
                    "n_points", "trend_raw", "avg_7d", "min_7d", "max_7d", "current",
                    F.col("avg_90d").alias("avg_90d_raw")))
