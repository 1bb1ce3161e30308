"""Data model: metric registry, units, aggregation rule, polarity and schemas.

The registry is tiny and fixed, so lookups are compiled into literal map
expressions (constant-folded by Catalyst, evaluated inside whole-stage
codegen) instead of being joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the behaviour being reproduced; they are
# data, not logic, and are listed in their natural order.
# ---------------------------------------------------------------------------

# Short metric name -> health record type identifier.
METRIC_TYPES = {
    "resting_heart_rate": "HKQuantityTypeIdentifierRestingHeartRate",
    "heart_rate": "HKQuantityTypeIdentifierHeartRate",
    "hrv": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "vo2max": "HKQuantityTypeIdentifierVO2Max",
    "walking_heart_rate_avg": "HKQuantityTypeIdentifierWalkingHeartRateAverage",
    "step_count": "HKQuantityTypeIdentifierStepCount",
    "active_energy": "HKQuantityTypeIdentifierActiveEnergyBurned",
    "exercise_minutes": "HKQuantityTypeIdentifierAppleExerciseTime",
    "sleep_analysis": "HKCategoryTypeIdentifierSleepAnalysis",
    "wrist_temperature": "HKQuantityTypeIdentifierAppleWalkingSteadiness",  # placeholder binding, kept as is
    "environmental_audio": "HKQuantityTypeIdentifierEnvironmentalAudioExposure",
    "running_power": "HKQuantityTypeIdentifierRunningPower",
    "ground_contact_time": "HKQuantityTypeIdentifierRunningGroundContactTime",
    "vertical_oscillation": "HKQuantityTypeIdentifierRunningVerticalOscillation",
    "water_temperature": "HKQuantityTypeIdentifierWaterTemperature",
    "underwater_depth": "HKQuantityTypeIdentifierUnderwaterDepth",
}

# Display unit per metric (default '').
METRIC_UNITS = {
    "resting_heart_rate": "bpm",
    "heart_rate": "bpm",
    "hrv": "ms",
    "vo2max": "mL/kg/min",
    "walking_heart_rate_avg": "bpm",
    "step_count": "steps",
    "active_energy": "kcal",
    "exercise_minutes": "min",
    "sleep_duration": "hrs",
    "sleep_analysis": "hrs",
    "wrist_temperature": "°C",
    "environmental_audio": "dBASPL",
    "running_power": "W",
    "ground_contact_time": "ms",
    "vertical_oscillation": "cm",
    "water_temperature": "°C",
    "underwater_depth": "m",
}

# Metrics whose daily value is a sum (zero-filled between first and last day).
CUMULATIVE_METRICS = [
    "step_count", "active_energy", "basal_energy_burned", "exercise_minutes",
    "distance_walking_running", "distance_cycling", "flights_climbed", "apple_stand_time",
]

# Polarity: which direction counts as improving.
HIGHER_IS_BETTER = [
    "hrv", "vo2max", "step_count", "active_energy",
    "sleep_duration", "exercise_minutes", "running_power",
]
LOWER_IS_BETTER = ["resting_heart_rate", "walking_heart_rate_avg", "ground_contact_time"]

# Keys that never become a plain daily series.
SKIP_METRICS = ["sleep_analysis", "workouts", "sleep_duration"]

# Sleep category code -> stage; anything else is "unknown".
SLEEP_STAGES = {0: "in_bed", 1: "asleep_unspecified", 2: "awake", 3: "core", 4: "deep", 5: "rem"}
SLEEP_EXCLUDED = ["in_bed", "awake"]
STAGE_COLUMNS = ["asleep_unspecified", "core", "deep", "rem", "unknown"]

WORKOUT_PREFIX = "HKWorkoutActivityType"
SLEEP_METRIC = "sleep_analysis"
SLEEP_DURATION_METRIC = "sleep_duration"

# Job parameters and their defaults.
ROLLING_WINDOWS = (7, 30, 90)
ANOMALY_THRESHOLD = 2.0
ANOMALY_WINDOW = 30
ANOMALY_MIN_PERIODS = 7
ANOMALY_MIN_POINTS = 10
TREND_WINDOW = 30
TREND_MIN_POINTS = 7
TREND_STABLE_BELOW = 0.10
RECENT_ANOMALY_DAYS = 14
REPORT_ANOMALY_DAYS = 7
EVENING_HOUR = 18
NIGHT_CUTOFF_HOUR = 18
CORR_MIN_PAIRS = 5
MONTHLY_SNAPSHOTS = 4

# The subject of an export whose path names none (one export, one person).
DEFAULT_SUBJECT = 0

# Date text as written in health exports, e.g. 2024-01-15 08:30:00 -0600.
EXPORT_TS_PATTERN = "yyyy-MM-dd HH:mm:ss Z"


def _lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


@dataclass(frozen=True)
class MetricDim:
    """Per-metric facts: daily aggregation rule, polarity and unit.

    Instances are small by construction (a registry of a few dozen names), so
    they are applied as literal map lookups -- no join, no broadcast.
    """

    agg: dict = field(default_factory=dict)       # metric -> 'sum' | 'mean'
    polarity: dict = field(default_factory=dict)  # metric -> 'higher' | 'lower'
    unit: dict = field(default_factory=dict)      # metric -> unit text
    hk_type: dict = field(default_factory=dict)   # metric -> record type id

    @staticmethod
    def health() -> "MetricDim":
        pol = {m: "higher" for m in HIGHER_IS_BETTER}
        pol.update({m: "lower" for m in LOWER_IS_BETTER})
        return MetricDim(
            agg={m: "sum" for m in CUMULATIVE_METRICS},
            polarity=pol,
            unit=dict(METRIC_UNITS),
            hk_type=dict(METRIC_TYPES),
        )

    def agg_expr(self, metric: Column) -> Column:
        if not self.agg:
            return F.lit("mean")
        return F.coalesce(_lit_map(self.agg)[metric], F.lit("mean"))

    def is_sum(self, metric: Column) -> Column:
        return self.agg_expr(metric) == F.lit("sum")

    def polarity_expr(self, metric: Column) -> Column:
        if not self.polarity:
            return F.lit(None).cast("string")
        return _lit_map(self.polarity)[metric]

    def unit_expr(self, metric: Column) -> Column:
        if not self.unit:
            return F.lit("")
        return F.coalesce(_lit_map(self.unit)[metric], F.lit(""))

    def metric_for_type(self, type_col: Column) -> Column:
        """Record type id -> short metric name (NULL when not registered)."""
        reverse = {v: k for k, v in self.hk_type.items()}
        if not reverse:
            return F.lit(None).cast("string")
        return _lit_map(reverse)[type_col]


# Canonical typed tables (see FIXTURES.md).
RECORDS_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("creation_ts", T.TimestampType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("start_local", T.TimestampNTZType()),
    T.StructField("end_local", T.TimestampNTZType()),
])

WORKOUTS_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("workout_activity_type", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("duration_unit", T.StringType()),
    T.StructField("total_distance", T.DoubleType()),
    T.StructField("total_distance_unit", T.StringType()),
    T.StructField("total_energy_burned", T.DoubleType()),
    T.StructField("total_energy_burned_unit", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("creation_ts", T.TimestampType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
    T.StructField("start_local", T.TimestampNTZType()),
])

SERIES_KEY = ["subject_id", "metric"]
