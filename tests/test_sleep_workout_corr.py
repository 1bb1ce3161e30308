import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import D0, daily_df, sleep_df, workouts_df
from pulsegrid.functions.stats import pearson_p_value
from pulsegrid.operators.correlate import (
    evening_workout_vs_sleep, intensity_vs_next_day_hrv, pearson, temp_deviation_vs_rhr_change,
)
from pulsegrid.operators.sleep import sleep_nightly, sleep_stages, sleep_stats, stage_totals
from pulsegrid.operators.workout import workout_by_type, workout_stats, workout_weekly


def test_night_attribution(spark):
    rows = [(1, f"2024-01-10 {h}", f"2024-01-10 {h[:2]}:59:59", 1) for h in ("17:59:00", "18:00:00", "23:30:00")]
    rows += [(1, f"2024-01-11 {h}", f"2024-01-11 {h[:2]}:30:00", 1) for h in ("02:00:00", "06:00:00")]
    n = {r.night: r.hours for r in sleep_nightly(stage_totals(sleep_df(spark, rows))).collect()}
    assert set(n) == {dt.date(2024, 1, 9), dt.date(2024, 1, 10)}


def test_two_codes_count_everything_three_codes_exclude(spark):
    two = [(1, "2024-01-10 22:00:00", "2024-01-10 23:00:00", 0), (1, "2024-01-10 23:00:00", "2024-01-11 01:00:00", 2)]
    n2 = sleep_nightly(stage_totals(sleep_df(spark, two))).first()
    assert n2.hours == pytest.approx(3.0)           # in bed + awake counted as sleep
    three = two + [(1, "2024-01-11 01:00:00", "2024-01-11 05:00:00", 3)]
    n3 = sleep_nightly(stage_totals(sleep_df(spark, three))).first()
    assert n3.hours == pytest.approx(4.0)           # only the core stage
    assert sleep_stages(stage_totals(sleep_df(spark, two))).count() == 0


def test_stage_pivot_unknown_overlap_null_end(spark):
    rows = [(1, "2024-01-10 22:00:00", "2024-01-10 23:00:00", c) for c in (0, 1, 2, 3, 4, 5)]
    rows += [(1, "2024-01-10 22:30:00", "2024-01-10 23:00:00", 9),      # unknown code, overlapping
             (1, "2024-01-10 22:30:00", "2024-01-10 22:45:00", None),   # null code -> unknown
             (1, "2024-01-10 22:30:00", None, 3)]                       # null end -> no duration
    totals = stage_totals(sleep_df(spark, rows))
    p = sleep_stages(totals).first().asDict()
    assert p["core"] == pytest.approx(60) and p["deep"] == pytest.approx(60) and p["rem"] == pytest.approx(60)
    assert p["asleep_unspecified"] == pytest.approx(60) and p["unknown"] == pytest.approx(45)
    assert sleep_nightly(totals).first().hours == pytest.approx(4.75)


def test_sleep_stats(spark):
    rows = [(1, f"2024-01-{d:02d} 20:00:00", f"2024-01-{d:02d} {20 + h}:00:00", 1) for d, h in ((1, 1), (2, 2), (3, 1))]
    s = sleep_stats(sleep_nightly(stage_totals(sleep_df(spark, rows)))).first()
    assert (s.mean_hrs, s.median_hrs, s.min_hrs, s.max_hrs, s.total_nights) == (1.33, 1.0, 1.0, 2.0, 3)
    assert s.std_hrs == pytest.approx(0.58)


WORKOUTS = [
    (1, "HKWorkoutActivityTypeRunning", 30, "2024-01-07 17:59:00"),   # Sunday
    (1, "HKWorkoutActivityTypeRunning", None, "2024-01-08 18:00:00"),  # Monday, evening
    (1, None, 20, "2024-01-08 07:00:00"),
    (1, "HKWorkoutActivityTypeCycling", 45, None),                    # no start
]


def test_workout_by_type(spark):
    got = {r.activity: (r.sessions, r.avg_duration_min) for r in workout_by_type(workouts_df(spark, WORKOUTS)).collect()}
    assert got == {"Running": (2, 30.0), "None": (1, 20.0), "Cycling": (1, 45.0)}


def test_workout_weekly_and_stats(spark):
    w = {r.week: r for r in workout_weekly(workouts_df(spark, WORKOUTS)).collect()}
    assert set(w) == {dt.date(2024, 1, 1), dt.date(2024, 1, 8)}
    assert (w[dt.date(2024, 1, 8)].total_duration_min, w[dt.date(2024, 1, 8)].session_count) == (20.0, 1)
    assert w[dt.date(2024, 1, 8)].avg_hr is None and w[dt.date(2024, 1, 8)].estimated_load == 20.0
    s = workout_stats(workouts_df(spark, WORKOUTS)).first()
    assert (s.total_workouts, s.total_duration_hrs, s.avg_duration_min, s.unique_types) == (3, 0.8, 25.0, 2)


def test_workout_heart_rate_load(spark):
    rows = [(1, "HKWorkoutActivityTypeRunning", 30, "2024-01-08 07:00:00", 150),
            (1, "HKWorkoutActivityTypeRunning", 15.55, "2024-01-09 07:00:00", 141)]
    w = workout_weekly(workouts_df(spark, rows, with_hr=True)).first()
    assert (w.total_duration_min, w.avg_hr) == (45.6, 145.5)
    assert w.estimated_load == round(45.6 * 145.5 / 100, 1)


def test_pairs_4_and_5(spark):
    a = daily_df(spark, {"x": [(i, i) for i in range(5)]}).drop("metric")
    b4 = daily_df(spark, {"y": [(i, i * i) for i in range(4)]}).drop("metric")
    b5 = daily_df(spark, {"y": [(i, i * i) for i in range(5)]}).drop("metric")
    r4 = pearson(a, b4, "t").first()
    r5 = pearson(a, b5, "t").first()
    assert (r4.n, r4.r, r4.p) == (4, None, None)
    assert r5.n == 5 and r5.r == pytest.approx(np.corrcoef(range(5), [i * i for i in range(5)])[0, 1], abs=1e-4)


def test_relation_exists_without_overlap(spark):
    a = daily_df(spark, {"x": [(i, i) for i in range(5)]}).drop("metric")
    b = daily_df(spark, {"y": [(i + 100, i) for i in range(5)]}).drop("metric")
    r = pearson(a, b, "t").first()
    assert (r.n, r.r) == (0, None)


def test_next_day_uses_calendar_shift(spark):
    # workouts on days 0, 2, 4, ...; HRV only on odd days: each pairs with d+1.
    wk = workouts_df(spark, [(1, "HKWorkoutActivityTypeRunning", 10 + d, f"2024-01-{d + 1:02d} 07:00:00")
                             for d in range(0, 20, 2)])
    hrv = daily_df(spark, {"hrv": [(d + 1, 100 - 2 * d) for d in range(0, 20, 2)]}).drop("metric")
    r = intensity_vs_next_day_hrv(wk, hrv).first()
    assert r.n == 10 and r.r == pytest.approx(-1.0) and r.p == 0.0


def test_evening_filter(spark):
    wk = workouts_df(spark, [(1, "HKWorkoutActivityTypeRunning", float(d), f"2024-01-{d:02d} {h}")
                             for d in range(1, 11) for h in ("17:59:00", "18:00:00")])
    sl = daily_df(spark, {"s": [(d - 1, 2.0 * d) for d in range(1, 11)]}).drop("metric")
    r = evening_workout_vs_sleep(wk, sl).first()
    assert r.n == 10 and r.r == pytest.approx(1.0)


def test_baseline_deviation_relation(spark):
    t = daily_df(spark, {"t": [(i, math.sin(i)) for i in range(40)]}).drop("metric")
    h = daily_df(spark, {"h": [(i, 2 * math.sin(i) + 1) for i in range(40)]}).drop("metric")
    r = temp_deviation_vs_rhr_change(t, h).first()
    assert r.n == 34 and r.r == pytest.approx(1.0)


def _t_sf(t, df, grid=400001):
    """Two-sided tail by direct numerical integration of the t density."""
    x = np.linspace(0, abs(t), grid)
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    pdf = np.exp(logc) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * np.trapezoid(pdf, x)


@pytest.mark.parametrize("r,n", [(0.1, 3), (0.5, 4), (0.3, 5), (0.8, 6), (-0.45, 12), (0.2, 31), (0.05, 200), (0.999, 8)])
def test_p_value_matches_numeric_integration(spark, r, n):
    got = spark.range(1).select(pearson_p_value(F.lit(r), F.lit(n)).alias("p")).first().p
    df = n - 2
    t = r * math.sqrt(df / (1 - r * r))
    assert got == pytest.approx(_t_sf(t, df), abs=1e-7)


def test_next_day_relation_equals_pandas_merge(spark):
    """Property of J2: equal to a plain merge on shifted calendar dates."""
    import random
    import pandas as pd
    rnd = random.Random(11)
    wk_rows, hrv_pts = [], []
    for d in range(60):
        if rnd.random() < 0.6:
            for _ in range(rnd.randint(1, 3)):
                wk_rows.append((1, "HKWorkoutActivityTypeRunning", rnd.uniform(10, 90),
                                f"{D0 + dt.timedelta(days=d)} {rnd.randint(5, 22):02d}:00:00"))
        if rnd.random() < 0.7:
            hrv_pts.append((d, rnd.uniform(20, 80)))
    r = intensity_vs_next_day_hrv(workouts_df(spark, wk_rows), daily_df(spark, {"h": hrv_pts}).drop("metric")).first()
    w = pd.DataFrame([(dt.date.fromisoformat(s[:10]), d) for _, _, d, s in wk_rows], columns=["date", "x"])
    w = w.groupby("date").x.mean()
    h = pd.Series({D0 + dt.timedelta(days=d - 1): v for d, v in hrv_pts})
    m = pd.concat([w.rename("x"), h.rename("y")], axis=1).dropna()
    assert r.n == len(m)
    assert r.r == pytest.approx(round(m.x.corr(m.y), 4), abs=1e-4)


def test_one_pass_correlations_equal_single_relations(spark):
    """C4 aligns all four relations in one aggregation; each relation's row
    must equal the relation computed on its own, for several subjects."""
    import random
    from pulsegrid.operators.correlate import correlations, sleep_vs_next_day_rhr
    rnd = random.Random(3)
    wk_rows, series = [], {}
    for subject in (1, 2, 3):
        for d in range(45):
            if rnd.random() < 0.5:
                wk_rows.append((subject, "HKWorkoutActivityTypeRunning", rnd.uniform(10, 90),
                                f"{D0 + dt.timedelta(days=d)} {rnd.randint(6, 22):02d}:00:00"))
        for m in ("hrv", "rhr", "temp", "sleep"):
            series[(subject, m)] = [(d, rnd.uniform(0, 10)) for d in range(45) if rnd.random() < 0.7]
    wk = workouts_df(spark, wk_rows)

    def s(m):
        out = None
        for subject in (1, 2, 3):
            part = daily_df(spark, {m: series[(subject, m)]}, subject=subject).drop("metric")
            out = part if out is None else out.unionByName(part)
        return out

    hrv, rhr, temp, sleep = s("hrv"), s("rhr"), s("temp"), s("sleep")
    singles = (intensity_vs_next_day_hrv(wk, hrv).unionByName(sleep_vs_next_day_rhr(sleep, rhr))
               .unionByName(evening_workout_vs_sleep(wk, sleep))
               .unionByName(temp_deviation_vs_rhr_change(temp, rhr)))
    key = lambda r: (r.subject_id, r.relationship)
    got = sorted(correlations(wk, hrv, rhr, temp, sleep).collect(), key=key)
    want = sorted(singles.collect(), key=key)
    assert len(got) == 12 and got == want
