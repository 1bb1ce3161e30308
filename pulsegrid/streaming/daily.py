"""Daily totals as a stateful stream (Structured Streaming, event time).

Readings are summed per (subject, metric, day of the reading) in the state store;
the watermark bounds how late a reading may be and when a day's state is dropped.
The query runs in update mode: each micro-batch emits the new totals of the days
it changed, and the sink replaces exactly those keys in a table partitioned by date,
reading and rewriting the dates of the batch only.  As a row holds the whole total
of its key, a batch that comes again after a failure changes nothing.

Readings later than the watermark are dropped by the state store, as its days are
closed; their number is returned, so that a job can recompute such days from the
stored readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.model import SERIES_KEY, MetricDim
from pulsegrid.operators.daily import daily_from_totals
from pulsegrid.session import materialize
from pulsegrid.sources.tables import read_if_present

DAYS_SCHEMA = "subject_id long, metric string, total double, n_values long, n long, date date"


def day_totals(readings: DataFrame, watermark: str) -> DataFrame:
    """The running totals of every (subject, metric, day); ``readings`` is a
    streaming table (subject_id, metric, start_ts, value)."""
    totals = (readings.where(F.col("start_ts").isNotNull()).withWatermark("start_ts", watermark)
              .groupBy(*SERIES_KEY, F.window("start_ts", "1 day").alias("day"))
              .agg(F.sum("value").alias("total"), F.count("value").alias("n_values"), F.count(F.lit(1)).alias("n")))
    return totals.select(*SERIES_KEY, "total", "n_values", "n", F.to_date("day.start").alias("date"))


def upsert_days(days: DataFrame, path: str) -> None:
    """Replace the keys of ``days`` in the table; dates without one aren't read."""
    spark, columns = days.sparkSession, ["subject_id", "metric", "total", "n_values", "n", "date"]
    days = materialize(days.select(*columns), "stream-days")
    dates = [r[0] for r in days.select("date").distinct().collect()]  # the days of one micro-batch
    old = read_days(spark, path)
    if old is not None:
        touched = old.where(F.col("date").isin(dates))
        days = materialize(touched.join(days, [*SERIES_KEY, "date"], "left_anti").select(*columns).unionByName(days), "stream-dates")
    (days.hint("rebalance", "date").sortWithinPartitions("date", *SERIES_KEY).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def read_days(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_present(lambda: spark.read.schema(DAYS_SCHEMA).parquet(path))


def run_daily(readings: DataFrame, path: str, checkpoint: str, watermark: str = "7 days") -> dict:
    """Take what has arrived and stop: rows read, and rows dropped as too late."""
    query = (day_totals(readings, watermark).writeStream.outputMode("update")
             .foreachBatch(lambda batch, _: upsert_days(batch, path))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    steps = query.recentProgress
    late = sum(s.numRowsDroppedByWatermark for p in steps for s in p.stateOperators)
    return {"rows": sum(p.numInputRows for p in steps), "late": late}


def daily_table(spark: SparkSession, path: str, dim: MetricDim) -> DataFrame:
    """The daily series of the totals stored so far."""
    days = read_days(spark, path)
    return daily_from_totals(spark.createDataFrame([], DAYS_SCHEMA) if days is None else days, dim)
