"""Plan-shape guards for the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as entry_mod
from pulsegrid.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()                                    # final AQE plan
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def _exchanges(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan)) + len(re.findall(r"Exchange SinglePartition", plan))


def test_anomalies_two_shuffles_pushdown_and_pruning(spark):
    plan = _plan(entry_mod.queries()["anomalies"](spark, SF))
    # partial aggregation before the first shuffle, one shuffle for all windows
    assert "partial_avg" in plan
    assert _exchanges(plan) == 2
    assert re.search(r"PushedFilters: \[[^\n]*IsNotNull\(ts\)", plan)
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "props" not in scan and "event_id" not in scan


def test_trend_and_anomaly_branches_share_the_daily_scan(spark):
    plan = _plan(entry_mod.queries()["trend_summary"](spark, SF))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_rolling_windows_share_one_exchange(spark):
    plan = _plan(entry_mod.queries()["rolling_7_30_90"](spark, SF))
    assert _exchanges(plan) == 2


def test_metric_filter_reaches_scan(spark):
    plan = _plan(entry_mod.queries()["daily_sum_zero_filled"](spark, SF))
    # the metric filter sits directly on the scan (the plan text truncates
    # long PushedFilters lists, so check the scan's Filter node)
    lines = plan.splitlines()
    at = [i for i, ln in enumerate(lines) if "Filter" in ln and "IN (click,purchase)" in ln]
    assert at and any("FileScan" in ln for ln in lines[at[-1] + 1: at[-1] + 4])


def test_sleep_flag_is_not_broadcast_or_collected(spark):
    plan = _plan(entry_mod.queries()["sleep_nightly"](spark, SF))
    assert "BroadcastExchange" not in plan
    assert "partial_sum" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udfs(spark, name):
    df = entry_mod.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_daily_with_sleep_keeps_one_series_exchange(spark):
    """The nightly sleep series joins the per-day rows before the gap-fill
    window, so the rolling windows reuse that window's (subject, metric)
    partitioning instead of shuffling every daily row again."""
    from pulsegrid.operators.daily import daily_series
    from pulsegrid.operators.rolling import rolling_means
    from pulsegrid.operators.sleep import sleep_nightly, stage_totals
    from pulsegrid.plans.standin import EVENTS_DIM, event_records, sleep_records

    nightly = sleep_nightly(stage_totals(sleep_records(spark, SF)))
    plan = _plan(rolling_means(daily_series(event_records(spark, SF), EVENTS_DIM, nightly)))
    series_exchanges = re.findall(r"Exchange hashpartitioning\(subject_id#\d+L, metric#\d+, \d+\)", plan)
    assert len(series_exchanges) == 1


def test_correlations_share_two_shuffles(spark):
    """C4 aligns every relation in one (subject, relationship, date)
    aggregation and reduces them in one (subject, relationship) aggregation."""
    from pulsegrid.plans.catalog import event_correlations

    plan = _plan(event_correlations(spark, SF))
    keyed = re.findall(r"Exchange hashpartitioning\(([^)]*relationship[^)]*)\)", plan)
    with_date = [k for k in keyed if "date#" in k]
    assert len(keyed) == 2 and len(with_date) == 1
