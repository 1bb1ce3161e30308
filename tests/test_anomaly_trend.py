import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import D0, daily_df
from pulsegrid.model import MetricDim
from pulsegrid.operators.anomaly import detect_anomalies
from pulsegrid.operators.rolling import rolling_baseline
from pulsegrid.operators.trend import classify_trends, trend_summary

DIM = MetricDim(polarity={"up_good": "higher", "down_good": "lower"})


def _jitter(n, base=10.0):
    return [(i, base + (0.001 if i % 2 else -0.001)) for i in range(n)]


def test_constant_series_never_flags(spark):
    d = daily_df(spark, {"m": [(i, 5.0) for i in range(12)]})
    assert detect_anomalies(d).count() == 0
    assert classify_trends(d, DIM).first().trend_raw == "stable"


def test_min_points_guard(spark):
    pts = _jitter(8) + [(8, 100.0)]          # 9 points: series too short
    assert detect_anomalies(daily_df(spark, {"m": pts})).count() == 0
    pts = _jitter(9) + [(9, 100.0)]          # 10 points: flagged
    assert detect_anomalies(daily_df(spark, {"m": pts})).count() == 1


def test_spike_14_is_high_spike_15_is_critical(spark):
    a14 = detect_anomalies(daily_df(spark, {"m": _jitter(13) + [(13, 1000.0)]})).collect()
    a15 = detect_anomalies(daily_df(spark, {"m": _jitter(14) + [(14, 1000.0)]})).collect()
    assert [r.severity for r in a14] == ["high"]
    assert a14[0].deviation_sigma == pytest.approx(13 / math.sqrt(14), abs=0.01)
    assert [r.severity for r in a15] == ["critical"]
    assert a15[0].deviation_sigma == pytest.approx(14 / math.sqrt(15), abs=0.01)


def test_anomaly_band_and_rounding(spark):
    r = detect_anomalies(daily_df(spark, {"m": _jitter(13) + [(13, 1000.0)]})).first()
    assert r.expected_low == pytest.approx(r.rolling_mean - 2 * r.rolling_std, abs=0.02)
    assert r.expected_high == pytest.approx(r.rolling_mean + 2 * r.rolling_std, abs=0.02)
    assert r.value == 1000.0 and r.date == D0 + dt.timedelta(days=13)


@pytest.mark.parametrize("metric,values,expected", [
    ("up_good", list(range(30)), "improving"),
    ("up_good", list(range(30, 0, -1)), "declining"),
    ("down_good", list(range(30)), "declining"),
    ("down_good", list(range(30, 0, -1)), "improving"),
    ("other", list(range(30)), "increasing"),
    ("other", list(range(30, 0, -1)), "decreasing"),
])
def test_ramps_and_polarity(spark, metric, values, expected):
    d = daily_df(spark, {metric: list(enumerate(values))})
    assert classify_trends(d, DIM).first().direction == expected


def test_noise_is_stable(spark):
    vals = [10, 12, 9, 11, 10, 13, 8, 11, 10, 12, 9, 11, 10, 12, 9, 11, 10, 12, 9, 11]
    d = daily_df(spark, {"m": list(enumerate(vals))})
    assert classify_trends(d, DIM).first().trend_raw == "stable"


@pytest.mark.parametrize("n,expected", [(6, "insufficient_data"), (7, "increasing")])
def test_short_series(spark, n, expected):
    d = daily_df(spark, {"m": [(i, float(i)) for i in range(n)]})
    assert classify_trends(d, DIM).first().trend_raw == expected


def test_trend_uses_last_30_points(spark):
    # 60 rising points then 30 flat ones: only the flat tail counts.
    pts = [(i, float(i)) for i in range(60)] + [(60 + i, 60.0) for i in range(30)]
    assert classify_trends(daily_df(spark, {"m": pts}), DIM).first().trend_raw == "stable"


def test_zero_mean_percent_is_null(spark):
    d = daily_df(spark, {"m": [(0, -1.0), (1, 1.0), (2, -2.0), (3, 2.0)]})
    t = trend_summary(d, detect_anomalies(d), DIM, "2024-01-10").first()
    assert t.pct_vs_90d is None and t.avg_90d == 0.0 and t.current_value == 2.0


def test_recent_anomalies_cutoffs(spark):
    from pulsegrid.operators.report import report_anomalies
    as_of = dt.date(2024, 3, 1)
    schema = ("subject_id bigint, date date, metric string, value double, rolling_mean double, "
              "rolling_std double, expected_low double, expected_high double, deviation_sigma double, severity string")
    rows = [(1, as_of - dt.timedelta(days=k), "m", 1.0, 0.0, 0.1, 0.0, 0.0, 2.5, "high") for k in (7, 8, 14, 15)]
    anomalies = spark.createDataFrame(rows, schema)
    d = daily_df(spark, {"m": [(i, float(i)) for i in range(10)]})
    t = trend_summary(d, anomalies, DIM, as_of).first()
    assert [a.date for a in t.recent_anomalies] == [as_of - dt.timedelta(days=k) for k in (7, 8, 14)]
    rep = report_anomalies(anomalies, as_of).collect()
    assert [r.date for r in rep] == [(as_of - dt.timedelta(days=7)).isoformat()]
    assert rep[0].deviation_text == "+2.50σ" and rep[0].callout == "warning" and rep[0].row_no == 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False), min_size=8, max_size=40))
def test_deviation_bound(spark, values):
    """With the current row inside its own window, dev <= (n-1)/sqrt(n)."""
    d = daily_df(spark, {"m": list(enumerate(values))})
    b = rolling_baseline(d).collect()
    rows = sorted(b, key=lambda r: r.date)
    for i, r in enumerate(rows):
        if r.rolling_std and r.rolling_std > 1e-9 * max(1.0, abs(r.rolling_mean)):
            n = min(i + 1, 30)
            dev = abs(r.value - r.rolling_mean) / r.rolling_std
            assert dev <= (n - 1) / math.sqrt(n) + 1e-6


def test_metric_log_new_page_then_upsert(spark):
    from pulsegrid.operators.report import metric_log
    from pulsegrid.operators.rolling import rolling_means
    d = daily_df(spark, {"up_good": [(i, float(i)) for i in range(10)]})
    trend = trend_summary(d, detect_anomalies(d), DIM, "2024-01-10")
    roll = rolling_means(d)
    first = metric_log(roll, trend, DIM, "2024-01-10")
    assert first.count() == 10 and {r.trend for r in first.collect()} == {"flat"}
    second = metric_log(roll, trend, DIM, "2024-01-11", existing=first).collect()   # appends
    assert len(second) == 11 and [r.trend for r in second if r.date == dt.date(2024, 1, 11)] == ["improving"]
    third = metric_log(roll, trend, DIM, "2024-01-09", existing=first).collect()   # replaces a history row
    row = [r for r in third if r.date == dt.date(2024, 1, 9)]
    assert len(third) == 10 and row[0].trend == "improving" and row[0].value == 9.0
