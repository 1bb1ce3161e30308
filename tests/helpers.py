"""Builders for tiny hand-made inputs (FIXTURES.md section 3)."""

import datetime as dt

from pyspark.sql import functions as F

D0 = dt.date(2024, 1, 1)


def daily_df(spark, series, subject=1):
    """series: {metric: [(day_offset, value), ...]} -> daily table."""
    data = [(subject, m, D0 + dt.timedelta(days=d), float(v)) for m, pts in series.items() for d, v in pts]
    return spark.createDataFrame(data, "subject_id bigint, metric string, date date, value double")


def records_df(spark, rows):
    """rows: (subject, metric, 'YYYY-MM-DD HH:MM:SS', value) -> records table."""
    data = [(s, m, dt.datetime.fromisoformat(t), None if v is None else float(v)) for s, m, t, v in rows]
    df = spark.createDataFrame(data, "subject_id bigint, metric string, start_local timestamp_ntz, value double")
    return df.withColumn("start_ts", F.col("start_local").cast("timestamp"))


def sleep_df(spark, rows):
    """rows: (subject, 'start', 'end' or None, code) -> sleep intervals."""
    data = [(s, dt.datetime.fromisoformat(a), None if b is None else dt.datetime.fromisoformat(b),
             None if c is None else float(c)) for s, a, b, c in rows]
    df = spark.createDataFrame(data, "subject_id bigint, start_local timestamp_ntz, end_local timestamp_ntz, value double")
    return (df.withColumn("start_ts", F.col("start_local").cast("timestamp"))
              .withColumn("end_ts", F.col("end_local").cast("timestamp")))


def workouts_df(spark, rows, with_hr=False):
    """rows: (subject, type, duration, 'start' or None[, hr])."""
    data = []
    for r in rows:
        s, t, d, start = r[:4]
        rec = [s, t, None if d is None else float(d), None if start is None else dt.datetime.fromisoformat(start)]
        if with_hr:
            rec.append(None if r[4] is None else float(r[4]))
        data.append(tuple(rec))
    schema = "subject_id bigint, workout_activity_type string, duration double, start_local timestamp_ntz"
    if with_hr:
        schema += ", average_heart_rate double"
    df = spark.createDataFrame(data, schema)
    return df.withColumn("start_ts", F.col("start_local").cast("timestamp"))
