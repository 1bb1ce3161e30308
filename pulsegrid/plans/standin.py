"""Role mapping of the driver's tables onto the health data model.

``events``  -> readings: user_id = subject, event_type = metric, ts = wall
clock, value = reading.  ``click`` and ``purchase`` are cumulative (summed);
the rest are averaged.
``events`` where event_type = 'view' -> sleep intervals: start = ts,
end = ts + floor(value) minutes, stage code = event_id % 7 (6 is unknown).
``events`` where event_type = 'purchase' -> workouts: start = ts,
duration = value minutes, activity = prefix || event_id % 4.
``orders`` -> one long history (a single subject, the all-rows-in-one-key
case): o_orderpriority = metric, o_orderdate = day, o_totalprice = value.

Every reader selects only the columns it needs, so the Parquet scan's
ReadSchema is pruned and metric filters reach the scan as PushedFilters.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.model import WORKOUT_PREFIX, MetricDim

# Stand-in dimension for the event types (parameters of the mapping).
EVENTS_DIM = MetricDim(
    agg={"click": "sum", "purchase": "sum"},
    polarity={"click": "higher", "purchase": "higher", "signup": "higher", "error": "lower",
              "sleep_duration": "higher"},
    unit={"click": "clicks", "purchase": "usd", "error": "errors", "signup": "signups", "view": "min",
          "sleep_duration": "hrs"},
    hk_type={"click": "Click", "purchase": "Purchase", "error": "Error", "signup": "Signup"},
)
ORDERS_DIM = MetricDim(unit={})

# The weekly run's report date for the January 2024 event data.
EVENTS_AS_OF = dt.date(2024, 1, 31)


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table ``name``; the scan DataFrame is built once per session
    (file listing and footer schema are read once, the plan is immutable)."""
    key = (id(spark), os.path.join(sf_dir, f"{name}.parquet"))
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(key[1])
    return df


def event_records(spark: SparkSession, sf_dir: str, metrics=None) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if metrics is not None:
        ev = ev.where(F.col("event_type").isin(*metrics))
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_type").alias("metric"),
        F.col("value"),
        F.col("ts").alias("start_local"),
        F.col("ts").cast("timestamp").alias("start_ts"),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit(0).cast("bigint").alias("subject_id"),
        F.col("o_orderpriority").alias("metric"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("start_local"),
    )


def sleep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.floor("value").cast("int"), F.lit(0))
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.lit("sleep_analysis").alias("metric"),
        (F.col("event_id") % 7).cast("double").alias("value"),
        F.col("ts").alias("start_local"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        end.cast("timestamp").alias("end_ts"),
    )


def workout_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.concat(F.lit(WORKOUT_PREFIX), (F.col("event_id") % 4).cast("string")).alias("workout_activity_type"),
        F.col("value").alias("duration"),
        F.col("ts").alias("start_local"),
        F.col("ts").cast("timestamp").alias("start_ts"),
    )


def event_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as raw export attributes (all text), for the typing
    path: type = initcap(event_type) ('View' is not registered), dates as
    'yyyy-MM-dd HH:mm:ss -0600', sleep-like 'view' values as category text."""
    ev = table(spark, sf_dir, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" -0600"))
    value = F.when(F.col("event_type") == "view", F.lit("HKCategoryValueSleepAnalysisAsleep")) \
        .otherwise(F.col("value").cast("string"))
    return ev.select(
        F.col("user_id").alias("subject_id"), F.initcap("event_type").alias("type"),
        F.lit("Watch").alias("sourceName"), F.lit("count").alias("unit"), value.alias("value"),
        stamp.alias("creationDate"), stamp.alias("startDate"), F.lit(None).cast("string").alias("endDate"))
