"""From raw text attributes to typed tables.

Raw rows (from any source) carry the export's attribute names as text.
Typing is pure projection + filter: no shuffle, so it pipelines with the
scan in one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.timeparse import parse_double, parse_instant, parse_local
from pulsegrid.model import MetricDim

DATE_ATTRS = ["creationDate", "startDate", "endDate"]


def classify_records(raw: DataFrame, dim: MetricDim) -> DataFrame:
    """Attach the short metric name; NULL when the type is not registered."""
    return raw.withColumn("metric", dim.metric_for_type(F.col("type")))


def kept_skipped(raw: DataFrame, dim: MetricDim) -> DataFrame:
    """Records kept (registered type) and skipped, as one grouped count."""
    c = classify_records(raw, dim)
    status = F.when(F.col("metric").isNotNull(), "kept").otherwise("skipped")
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_records"))


def type_records(raw: DataFrame, dim: MetricDim, category_codes: dict | None = None) -> DataFrame:
    """P1 + P2 + P3 + F1 + F2: the typed ``records`` table.

    Rows whose three dates are all unparseable are dropped; a row with only
    a bad start date is kept (it is dropped later, from daily series).
    ``category_codes`` (text -> code) is the opt-in fix of D2: sleep stages
    arrive as category text, which the numeric rule turns into NULL.
    """
    c = classify_records(raw, dim).where(F.col("metric").isNotNull())
    value = parse_double("value")
    if category_codes:
        pairs = []
        for k, v in category_codes.items():
            pairs += [F.lit(k), F.lit(float(v))]
        value = F.coalesce(value, F.create_map(*pairs)[F.col("value")])
    typed = c.select(
        "subject_id", "metric",
        F.col("sourceName").alias("source_name"), "unit",
        value.alias("value"),
        parse_instant("creationDate").alias("creation_ts"),
        parse_instant("startDate").alias("start_ts"),
        parse_instant("endDate").alias("end_ts"),
        parse_local("startDate").alias("start_local"),
        parse_local("endDate").alias("end_local"),
    )
    return typed.na.drop(how="all", subset=["creation_ts", "start_ts", "end_ts"])


def type_workouts(raw: DataFrame) -> DataFrame:
    """The typed ``workouts`` table (numeric columns to DOUBLE, dates parsed)."""
    typed = raw.select(
        "subject_id",
        F.col("workoutActivityType").alias("workout_activity_type"),
        parse_double("duration").alias("duration"),
        F.col("durationUnit").alias("duration_unit"),
        parse_double("totalDistance").alias("total_distance"),
        F.col("totalDistanceUnit").alias("total_distance_unit"),
        parse_double("totalEnergyBurned").alias("total_energy_burned"),
        F.col("totalEnergyBurnedUnit").alias("total_energy_burned_unit"),
        F.col("sourceName").alias("source_name"),
        parse_instant("creationDate").alias("creation_ts"),
        parse_instant("startDate").alias("start_ts"),
        parse_instant("endDate").alias("end_ts"),
        parse_local("startDate").alias("start_local"),
    )
    return typed.na.drop(how="all", subset=["creation_ts", "start_ts", "end_ts"])


def dataset_profile(records: DataFrame) -> DataFrame:
    """Rows and first / last start per metric."""
    return records.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"),
        F.date_format(F.min("start_local"), "yyyy-MM-dd HH:mm:ss").alias("first_start"),
        F.date_format(F.max("start_local"), "yyyy-MM-dd HH:mm:ss").alias("last_start"))


def dataset_totals(records: DataFrame) -> DataFrame:
    """Total records and number of metrics."""
    return records.agg(F.count(F.lit(1)).alias("total_records"),
                       F.count_distinct("metric").alias("n_metrics"))
