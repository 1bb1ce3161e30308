import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import D0, daily_df, records_df
from pulsegrid.model import MetricDim
from pulsegrid.operators.daily import daily_values
from pulsegrid.operators.rolling import chart_data, rolling_baseline, rolling_means, series_stats

DIM = MetricDim(agg={"steps": "sum"})


def _recs(spark, metric, days, value=1.0):
    return records_df(spark, [(1, metric, f"2024-01-{d:02d} 10:00:00", value) for d in days])


def test_gap_sum_zero_filled(spark):
    d = daily_values(_recs(spark, "steps", [1, 4, 5], 2.0), DIM).orderBy("date").collect()
    assert [(r.date.day, r.value) for r in d] == [(1, 2.0), (2, 0.0), (3, 0.0), (4, 2.0), (5, 2.0)]


def test_gap_mean_sparse(spark):
    d = daily_values(_recs(spark, "hr", [1, 4, 5], 2.0), DIM).orderBy("date").collect()
    assert [r.date.day for r in d] == [1, 4, 5]


def test_null_values_and_dates(spark):
    rows = [(1, "steps", "2024-01-01 10:00:00", None), (1, "steps", "2024-01-03 10:00:00", 5.0),
            (1, "hr", "2024-01-01 10:00:00", None), (1, "hr", "2024-01-02 10:00:00", 60.0)]
    recs = records_df(spark, rows).union(
        spark.createDataFrame([(1, "hr", None, 99.0, None)], "subject_id bigint, metric string, "
                              "start_local timestamp_ntz, value double, start_ts timestamp"))
    d = {(r.metric, r.date.day): r.value for r in daily_values(recs, DIM).collect()}
    # all-null sum day -> 0.0, spine day -> 0.0; all-null mean day absent; null date dropped
    assert d == {("steps", 1): 0.0, ("steps", 2): 0.0, ("steps", 3): 5.0, ("hr", 2): 60.0}


def test_skip_keys(spark):
    recs = _recs(spark, "sleep_analysis", [1, 2])
    assert daily_values(recs, DIM).count() == 0


@pytest.mark.parametrize("n", [1, 2, 6, 7, 9, 10, 29, 30, 90])
def test_min_periods(spark, n):
    r = rolling_means(daily_df(spark, {"m": [(i, i) for i in range(n)]})).orderBy("date").collect()
    first = {w: next((i for i, x in enumerate(r) if x[f"rolling_{w}"] is not None), None) for w in (7, 30, 90)}
    assert first[7] == (1 if n >= 2 else None)
    assert first[30] == (9 if n >= 10 else None)
    assert first[90] == (29 if n >= 30 else None)


def test_rows_not_calendar(spark):
    # 30 points every other day: the 7-row window spans 13 calendar days.
    r = rolling_means(daily_df(spark, {"m": [(2 * i, i) for i in range(30)]})).orderBy("date").collect()
    assert r[6]["rolling_7"] == pytest.approx(sum(range(7)) / 7)
    assert r[29]["rolling_7"] == pytest.approx(sum(range(23, 30)) / 7)


def test_rolling_matches_pandas(spark):
    rnd = random.Random(7)
    series = {f"m{k}": [(d, rnd.uniform(0, 100)) for d in sorted(rnd.sample(range(200), rnd.randint(1, 120)))]
              for k in range(6)}
    got = rolling_means(daily_df(spark, series)).toPandas()
    for m, pts in series.items():
        s = pd.Series([v for _, v in pts], index=[D0 + dt.timedelta(days=d) for d, _ in pts])
        g = got[got.metric == m].sort_values("date")
        for w in (7, 30, 90):
            exp = s.rolling(w, min_periods=max(1, w // 3)).mean().to_numpy()
            act = g[f"rolling_{w}"].astype(float).to_numpy()
            assert pd.isna(exp).tolist() == pd.isna(act).tolist()
            assert exp[~pd.isna(exp)] == pytest.approx(act[~pd.isna(act)], rel=1e-9)


def test_baseline_matches_pandas(spark):
    rnd = random.Random(3)
    pts = [(d, rnd.gauss(50, 5)) for d in range(45)]
    got = rolling_baseline(daily_df(spark, {"m": pts})).orderBy("date").toPandas()
    s = pd.Series([v for _, v in pts])
    mu = s.rolling(30, min_periods=7).mean().to_numpy()
    sd = s.rolling(30, min_periods=7).std().to_numpy()
    assert got.rolling_mean.astype(float).to_numpy()[6:] == pytest.approx(mu[6:], rel=1e-9)
    assert got.rolling_std.astype(float).to_numpy()[6:] == pytest.approx(sd[6:], rel=1e-9)
    assert got.rolling_mean.isna().tolist()[:6] == [True] * 6
    assert set(got.series_points) == {45}


def test_series_stats_last_n(spark):
    pts = [(d, float(d)) for d in range(100)]
    st = series_stats(daily_df(spark, {"m": pts})).first()
    assert st.current == 99.0 and st.n_points == 100
    assert st.avg_7d == pytest.approx(sum(range(93, 100)) / 7)
    assert (st.min_7d, st.max_7d) == (93.0, 99.0)
    assert st.avg_90d == pytest.approx(sum(range(10, 100)) / 90)
    assert st.n_trend == 30 and st.slope_trend == pytest.approx(1.0)


def test_chart_last90_gate(spark):
    d = daily_df(spark, {"one": [(0, 1.0)], "many": [(i, 1.0) for i in range(120)]})
    c = chart_data(rolling_means(d))
    counts = {r.metric: r["count"] for r in c.groupBy("metric").count().collect()}
    assert counts == {"many": 90}


def test_chart_sorts_once(spark):
    d = daily_df(spark, {"many": [(i, float(i)) for i in range(120)], "two": [(0, 1.0), (1, 2.0)]}, subject=1)
    c = chart_data(rolling_means(d)).sortWithinPartitions("subject_id", "metric", "date")
    assert [(r.metric, r.raw) for r in c.coalesce(1).collect()] == [("many", float(i)) for i in range(30, 120)] + [("two", 1.0), ("two", 2.0)]
    assert "DESC" not in c._jdf.queryExecution().optimizedPlan().toString()
    assert chart_data(rolling_means(d), 1).isEmpty()


def test_partition_count_does_not_change_results(spark):
    d = daily_df(spark, {f"m{k}": [(i, (i * 7919 + k) % 101) for i in range(60)] for k in range(5)})
    a = sorted(map(tuple, rolling_means(d).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, rolling_means(d.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_date_column_by_presence(spark):
    from pulsegrid.operators.daily import pick_date_column
    recs = _recs(spark, "hr", [1, 2])
    assert pick_date_column(recs) == "start_local"
    assert pick_date_column(recs.withColumn("date", F.to_date("start_local"))) == "date"
    assert pick_date_column(recs.drop("start_local", "start_ts")) is None
    assert daily_values(recs.drop("start_local", "start_ts"), DIM).count() == 0


def test_nan_text_is_missing(spark):
    from pulsegrid.functions.timeparse import parse_double
    got = [r.v for r in spark.createDataFrame([("nan",), ("7",), (" 7 ",), ("x",), ("",), (None,)], "t string")
           .select(parse_double("t").alias("v")).collect()]
    assert got == [None, 7.0, 7.0, None, None, None]
