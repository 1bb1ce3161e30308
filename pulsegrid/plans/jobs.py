"""Registered queries of the jobs: streams, the weekly run with a fault in it,
written order, tables of other shapes, job parameters; and their SQL.

As in ``plans.catalog`` every callable takes ``(spark, sf_dir)`` and works on the
whole driver tables.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pulsegrid.functions.rounding import half_up
from pulsegrid.model import MetricDim
from pulsegrid.operators.anomaly import detect_anomalies
from pulsegrid.operators.daily import daily_values
from pulsegrid.operators.report import top_anomalies
from pulsegrid.operators.rolling import rolling_means
from pulsegrid.operators.trend import trend_summary
from pulsegrid.operators.typing import type_records, type_workouts
from pulsegrid.operators.workout import daily_intensity, workout_by_type, workout_weekly
from pulsegrid.plans import oracle
from pulsegrid.plans.analysis import REPORT_ORDER, run
from pulsegrid.plans.catalog import _folder, _still_there, event_daily, stored_totals, write_exports
from pulsegrid.plans.oracle import EV_AS_OF, anomalies_select, ev_daily, rnd, stats_ctes
from pulsegrid.plans.standin import EVENTS_AS_OF, EVENTS_DIM, event_raw_records, event_records, table, workout_records
from pulsegrid.sources.reports import out_of_order, read_metric_log, read_report, write_report
from pulsegrid.sources.snapshots import load_snapshots
from pulsegrid.sources.tables import write_version
from pulsegrid.sources.xml import exports
from pulsegrid.streaming.daily import daily_table, run_daily
from pulsegrid.streaming.ingest import ingest_available

# -- streams ------------------------------------------------------------------------

#: Days of readings in a wave of the stream, and how much later some of them come.
WAVE_DAYS = 10
WATERMARK = "15 days"


def q_streaming_daily(spark, sf):
    """Events arriving in three waves, every tenth of them a wave late, summed by
    day in the state of a stream; the daily series of the table it upserts."""
    landing, path, checkpoint = (_folder(spark, name) for name in ("readings", "days", "checkpoint"))
    readings = event_records(spark, sf)
    events = table(spark, sf, "events")
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    wave = F.floor(F.datediff("ts", F.lit(first)) / WAVE_DAYS) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    rows = events.select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("metric"), "value",
                         F.col("ts").cast("timestamp").alias("start_ts"), F.least(wave, F.lit(2)).alias("wave"))
    schema = readings.select("subject_id", "metric", "value", "start_ts").schema
    for k in range(3):
        rows.where(F.col("wave") == k).drop("wave").write.mode("append").parquet(landing)
        run_daily(spark.readStream.schema(schema).parquet(landing), path, checkpoint, WATERMARK)
    return daily_table(spark, path, EVENTS_DIM).select("subject_id", "metric", "date", half_up("value", 4).alias("value"))


def q_streaming_ingest(spark, sf):
    """``ingest_roundtrip`` as a stream: two landings, in micro-batches of a
    bounded number of files, each batch appended; the newest exports read back."""
    landing, tables, checkpoint = (_folder(spark, name) for name in ("landing", "tables", "checkpoint"))
    raw = event_raw_records(spark, sf)

    def arrive(name, rows):
        folder = os.path.join(landing, name)
        write_exports(rows, folder)
        n_files = exports(spark, folder).count()
        ingest_available(spark, landing, tables, checkpoint, EVENTS_DIM, buckets=8, files_per_batch=n_files // 2 + 1, compact_parts=99)

    arrive("1", raw)
    arrive("2", raw.where("type <> 'Error'").join(_still_there(spark, sf), "subject_id", "left_semi"))
    return stored_totals(spark, tables)


# -- the weekly job ------------------------------------------------------------------------

EARLIER = "2024-01-24"


class Lost(RuntimeError):
    """The fault of ``q_weekly_run``."""


def q_weekly_run(spark, sf):
    """C14 over two report dates from export XML.  The second run fails between
    two sinks, its snapshot and first reports written, and is run again; what the
    stores and reports then hold per subject and report date."""
    landing, dst = _folder(spark, "landing"), _folder(spark, "job")
    write_exports(event_raw_records(spark, sf), landing)
    names = {"dim": EVENTS_DIM, "hrv": "signup", "rhr": "error", "temp": "click"}
    run(spark, landing, dst, EARLIER, **names)

    def lost(step):
        if step == "metric_log":
            raise Lost(step)

    try:
        run(spark, landing, dst, str(EVENTS_AS_OF), before=lost, **names)
    except Lost:
        pass
    else:
        raise AssertionError("the run was to fail")
    run(spark, landing, dst, str(EVENTS_AS_OF), force_monthly=True, **names)
    reports, key = os.path.join(dst, "reports"), ["subject_id", "report_date"]
    count = F.count(F.lit(1))
    dated = lambda name: read_report(spark, reports, name).withColumn("report_date", F.col("report_date").cast("date"))
    parts = [
        dated("overview").groupBy(key).agg(count.alias("n_overview"), half_up(F.sum("current_value"), 2).alias("sum_current"),
                                           F.count_if(F.col("wow_direction") == "unchanged").alias("n_unchanged")),
        dated("anomalies").groupBy(key).agg(count.alias("n_anomalies")),
        dated("monthly_totals").select(*key, "weeks_covered", "total_anomalies", "total_workouts"),
        read_metric_log(spark, reports).withColumnRenamed("date", "report_date").groupBy(key).agg(
            count.alias("n_log"), half_up(F.sum("value"), 2).alias("sum_log")),
    ]
    out = load_snapshots(spark, os.path.join(dst, "snapshots"))[1].select(*key, "run_number", "anomaly_count", "workout_count", "workouts_in_week")
    for part in parts:
        out = out.join(part, key, "left")
    numbers = [c for c in out.columns if c.startswith("n_")]
    return out.fillna(0, numbers)


# -- written order (K1-K4) -----------------------------------------------------------------------

def q_report_order(spark, sf):
    """Records, workouts and reports written by their sinks: rows, and rows out of
    their order by place in the files."""
    root = _folder(spark, "ordered")
    raw = event_raw_records(spark, sf)
    works = type_workouts(raw.where("type = 'Purchase'").select(
        "subject_id", F.lit("HKWorkoutActivityTypeOther").alias("workoutActivityType"), F.col("value").alias("duration"),
        *[F.lit(None).cast("string").alias(c) for c in ("durationUnit", "totalDistance", "totalDistanceUnit", "totalEnergyBurned",
                                                        "totalEnergyBurnedUnit")], "sourceName", "creationDate", "startDate", "endDate"))
    manifest = raw.select("subject_id", F.lit("x").alias("path"), F.lit(None).cast("timestamp").alias("mtime"),
                          F.lit(0).cast("long").alias("length")).distinct()
    write_version(spark, os.path.join(root, "tables"), type_records(raw, EVENTS_DIM), works, manifest, buckets=8)
    workouts, daily = workout_records(spark, sf), event_daily(spark, sf)
    reports = {"workouts_by_type": workout_by_type(workouts), "workout_weekly": workout_weekly(workouts),
               "top_anomalies": top_anomalies(detect_anomalies(daily))}
    checks = [(name, os.path.join(root, "tables", name), ["subject_id", "start_ts"]) for name in ("records", "workouts")]
    for name, df in reports.items():
        checks.append((name, write_report(df.hint("rebalance"), root, name, order_by=REPORT_ORDER[name]), REPORT_ORDER[name]))
    out = None
    for name, path, order in checks:
        one = out_of_order(spark.read.parquet(path), order).select(F.lit(name).alias("report"), "n_rows", "n_out_of_order")
        out = one if out is None else out.unionByName(one)
    return out


# -- tables of other shapes (P5-P7), registry and parameters (S9, S13) ----------------------------

def _dated_workouts(spark, sf):
    """Workouts with a date only and the other name of the duration."""
    return workout_records(spark, sf).select("subject_id", "workout_activity_type", F.col("duration").alias("total_duration"),
                                             F.to_date("start_local").alias("date"))


def _measured_workouts(spark, sf):
    """Workouts with an average heart rate, missing in every thirteenth."""
    ev = table(spark, sf, "events").where("event_type = 'purchase'")
    rate = F.when(F.col("event_id") % 13 != 0, (60 + F.col("event_id") % 97).cast("double"))
    return ev.select(F.col("user_id").alias("subject_id"), F.lit("Run").alias("type"), F.col("value").alias("duration"),
                     F.col("ts").alias("start_local"), rate.alias("average_heart_rate"))


def q_workout_weekly_date_only(spark, sf):
    return workout_weekly(_dated_workouts(spark, sf))


def q_workout_weekly_heart_rate(spark, sf):
    return workout_weekly(_measured_workouts(spark, sf))


def q_intensity_heart_rate(spark, sf):
    """Mean heart rate of the evening's workouts per day."""
    return daily_intensity(_measured_workouts(spark, sf), evening_hour=18).select("subject_id", "date", half_up("value", 4).alias("value"))


#: Events in the real registry: two summed metrics, one better if higher, one better if lower, one neutral.
HEALTH_NAMES = {"click": "step_count", "purchase": "active_energy", "signup": "hrv", "error": "resting_heart_rate", "view": "heart_rate"}
THRESHOLD = 1.5
WINDOWS = (5, 14)


def _health_daily(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in HEALTH_NAMES.items() for x in pair])
    return daily_values(event_records(spark, sf).withColumn("metric", names[F.col("metric")]), MetricDim.health())


def q_registry_anomalies(spark, sf):
    """The real registry, another threshold."""
    return detect_anomalies(_health_daily(spark, sf), THRESHOLD)


def q_registry_trend(spark, sf):
    daily = _health_daily(spark, sf)
    dim = MetricDim.health()
    trend = trend_summary(daily, detect_anomalies(daily, THRESHOLD), dim, EVENTS_AS_OF)
    return trend.select("subject_id", "metric", "direction", "current_value", dim.unit_expr(F.col("metric")).alias("unit"))


def q_registry_rolling(spark, sf):
    """Other windows than the default ones."""
    rolling = rolling_means(_health_daily(spark, sf), WINDOWS)
    return rolling.select("subject_id", "metric", "date", *[half_up(c, 4).alias(c) for c in ("raw", *(f"rolling_{n}" for n in WINDOWS))])


QUERIES = {
    "streaming_daily": q_streaming_daily,
    "streaming_ingest": q_streaming_ingest,
    "weekly_run": q_weekly_run,
    "report_order": q_report_order,
    "workout_weekly_date_only": q_workout_weekly_date_only,
    "workout_weekly_heart_rate": q_workout_weekly_heart_rate,
    "intensity_heart_rate": q_intensity_heart_rate,
    "registry_anomalies": q_registry_anomalies,
    "registry_trend": q_registry_trend,
    "registry_rolling": q_registry_rolling,
}

# -- SQL -----------------------------------------------------------------------------------------

#: Daily series of the registered metrics only, as the exports of the weekly job have them.
JOB_DAILY = f"{ev_daily('every')}, daily AS (SELECT * FROM every WHERE metric <> 'view')"

WEEKLY_RUN = f"""
WITH {JOB_DAILY}, {stats_ctes('daily')}, fan AS ({anomalies_select('daily')}),
subjects AS (SELECT DISTINCT subject_id FROM tl),
dates AS (SELECT * FROM (VALUES (DATE '{EARLIER}', CAST(1 AS BIGINT)), ({EV_AS_OF}, CAST(2 AS BIGINT))) v(report_date, run_number)),
works AS (
  SELECT user_id AS subject_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
own AS (
  SELECT user_id AS subject_id, d.report_date, count(*) AS n
  FROM events JOIN dates d ON date_trunc('week', ts) = date_trunc('week', d.report_date)
  WHERE event_type = 'purchase' GROUP BY 1, 2),
flags AS (SELECT subject_id, count(*) AS n FROM fan GROUP BY 1),
base AS (
  SELECT s.subject_id, d.report_date, d.run_number, coalesce(f.n, 0) AS anomaly_count, coalesce(w.n, 0) AS workout_count,
         coalesce(o.n, 0) AS workouts_in_week
  FROM subjects s CROSS JOIN dates d LEFT JOIN flags f USING (subject_id) LEFT JOIN works w USING (subject_id)
       LEFT JOIN own o USING (subject_id, report_date)),
over AS (
  SELECT subject_id, count(*) AS n_overview, {rnd(f"sum({rnd('cur', 2)})", 2)} AS sum_current
  FROM tl WHERE direction <> 'insufficient_data' GROUP BY 1),
near AS (
  SELECT f.subject_id, d.report_date, count(*) AS n
  FROM fan f JOIN dates d ON f.date >= d.report_date - INTERVAL 7 DAY GROUP BY 1, 2),
month AS (
  SELECT subject_id, {EV_AS_OF} AS report_date, count(*) AS weeks_covered, CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies,
         CAST(sum(workout_count) AS BIGINT) AS total_workouts
  FROM base GROUP BY 1),
log AS (
  SELECT d.subject_id, d.date AS report_date, d.value FROM daily d JOIN tl t USING (subject_id, metric)
  WHERE t.direction <> 'insufficient_data' AND d.date <> {EV_AS_OF}
  UNION ALL
  SELECT subject_id, {EV_AS_OF}, cur FROM tl WHERE direction <> 'insufficient_data'),
logged AS (
  SELECT subject_id, report_date, count(*) AS n_log, {rnd(f"sum({rnd('value', 2)})", 2)} AS sum_log FROM log GROUP BY 1, 2)
SELECT b.*, coalesce(v.n_overview, 0) AS n_overview, v.sum_current,
       CASE WHEN b.run_number = 2 THEN coalesce(v.n_overview, 0) ELSE 0 END AS n_unchanged, coalesce(n.n, 0) AS n_anomalies,
       m.weeks_covered, m.total_anomalies, m.total_workouts, coalesce(l.n_log, 0) AS n_log, l.sum_log
FROM base b LEFT JOIN over v USING (subject_id) LEFT JOIN near n USING (subject_id, report_date)
     LEFT JOIN month m USING (subject_id, report_date) LEFT JOIN logged l USING (subject_id, report_date)
"""


def _counted(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS report, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_out_of_order FROM ({sql})"


MEASURED = """
mw AS (
  SELECT user_id AS subject_id, ts, value AS d,
         CASE WHEN event_id % 13 <> 0 THEN CAST(60 + event_id % 97 AS DOUBLE) END AS hr
  FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL)
"""

_renamed = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in HEALTH_NAMES.items()) + " END"
HEALTH_DAILY = ev_daily().replace("event_type AS metric", f"{_renamed} AS metric").replace(
    oracle.SUM_TYPES, "('step_count', 'active_energy')")
HEALTH_STATS = stats_ctes("daily").replace(
    "('click', 'purchase', 'signup', 'sleep_duration')", "('step_count', 'active_energy', 'hrv')").replace("('error')", "('resting_heart_rate')")


def _rolling(n: int) -> str:
    frame = f"OVER (PARTITION BY subject_id, metric ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"{rnd(f'CASE WHEN count(value) {frame} >= {max(1, n // 3)} THEN avg(value) {frame} END', 4)} AS rolling_{n}"


ORACLE = {
    "streaming_daily": f"WITH {ev_daily()} SELECT subject_id, metric, date, {rnd('value', 4)} AS value FROM daily",
    "streaming_ingest": oracle.ORACLE["ingest_roundtrip"],
    "weekly_run": WEEKLY_RUN,
    "report_order": " UNION ALL ".join([
        _counted("records", "SELECT 1 FROM events WHERE event_type <> 'view' AND ts IS NOT NULL"),
        _counted("workouts", "SELECT 1 FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL"),
        _counted("workouts_by_type", oracle.ORACLE["workouts_by_type"]),
        _counted("workout_weekly", oracle.ORACLE["workout_weekly_load"]),
        _counted("top_anomalies", f"WITH {ev_daily()}, fan AS ({anomalies_select('daily')}) SELECT 1 FROM fan "
                                  "QUALIFY row_number() OVER (PARTITION BY subject_id, metric ORDER BY date DESC) <= 5"),
    ]),
    "workout_weekly_date_only": oracle.ORACLE["workout_weekly_load"],
    "workout_weekly_heart_rate": f"""
WITH {MEASURED},
w AS (SELECT subject_id, CAST(date_trunc('week', ts) AS DATE) AS week, {rnd("coalesce(sum(d), 0.0)", 1)} AS total_duration_min,
             count(d) AS session_count, {rnd("avg(hr)", 1)} AS avg_hr FROM mw GROUP BY 1, 2)
SELECT *, {rnd("total_duration_min * avg_hr / 100", 1)} AS estimated_load FROM w
""",
    "intensity_heart_rate": f"""
WITH {MEASURED}
SELECT subject_id, CAST(ts AS DATE) AS date, {rnd("avg(hr)", 4)} AS value FROM mw WHERE hour(ts) >= 18 GROUP BY 1, 2
""",
    "registry_anomalies": f"WITH {HEALTH_DAILY} {anomalies_select('daily', THRESHOLD)}",
    "registry_trend": f"""
WITH {HEALTH_DAILY}, {HEALTH_STATS}
SELECT subject_id, metric, direction, {rnd("cur", 2)} AS current_value,
       CASE metric WHEN 'step_count' THEN 'steps' WHEN 'active_energy' THEN 'kcal' WHEN 'hrv' THEN 'ms' ELSE 'bpm' END AS unit
FROM tl
""",
    "registry_rolling": f"""
WITH {HEALTH_DAILY}
SELECT subject_id, metric, date, {rnd("value", 4)} AS raw, {", ".join(map(_rolling, WINDOWS))} FROM daily
""",
}
