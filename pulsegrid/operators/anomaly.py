"""Anomaly detection (C5: P12, P13, W2, W12, F9, F10, F23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.functions.labels import severity
from pulsegrid.model import (
    ANOMALY_MIN_PERIODS, ANOMALY_MIN_POINTS, ANOMALY_THRESHOLD, ANOMALY_WINDOW, SERIES_KEY,
)
from pulsegrid.operators.rolling import rolling_baseline


def detect_anomalies(daily: DataFrame, threshold: float = ANOMALY_THRESHOLD,
                     window: int = ANOMALY_WINDOW, min_periods: int = ANOMALY_MIN_PERIODS,
                     min_points: int = ANOMALY_MIN_POINTS, keys=None) -> DataFrame:
    """Flag days whose value is >= ``threshold`` rolling standard deviations
    from the rolling mean (current row included in its own window).

    Series with fewer than ``min_points`` days are skipped; a zero or missing
    rolling std never flags.  Numbers are rounded to 2 digits only in the
    output projection; severity uses the unrounded deviation.
    """
    keys = keys or SERIES_KEY
    base = rolling_baseline(daily, window, min_periods, keys)
    mu, sigma = F.col("rolling_mean"), F.col("rolling_std")
    dev = F.try_divide(F.abs(F.col("value") - mu), sigma)
    flagged = (base
               .where((F.col("series_points") >= min_points) & mu.isNotNull() & sigma.isNotNull()
                      & (sigma != 0))
               .withColumn("dev", dev)
               .where(F.col("dev") >= threshold))
    return flagged.select(
        *[k for k in keys if k != "metric"], "date", "metric",
        half_up("value", 2).alias("value"),
        half_up(mu, 2).alias("rolling_mean"),
        half_up(sigma, 2).alias("rolling_std"),
        half_up(mu - threshold * sigma, 2).alias("expected_low"),
        half_up(mu + threshold * sigma, 2).alias("expected_high"),
        half_up("dev", 2).alias("deviation_sigma"),
        severity(F.col("dev"), threshold).alias("severity"),
    )
