"""Snapshot history store.

Our store is two Parquet tables partitioned by ``report_date``:
``<path>/runs`` (snapshot_run) and ``<path>/metrics`` (snapshot_metric).
Saving is an upsert: the report dates being saved are rewritten with dynamic
partition overwrite, all others are left untouched and unread.  A subject's run
number is kept when its report date already exists, otherwise it is the subject's
highest run number + 1.  That highest number is *state*: one row per subject
(``<path>/state/save=<n>``), written anew by each save.  ``<path>/log`` gets a line
when a save begins and one, naming its state, when it is done; where the last
line is a beginning, that save has failed and the state is taken from all runs
instead.  The new rows are first written to the shared checkpoint folder, so the
overwrite never reads the files it replaces.

The JSON history format (snapshot objects with a ``metrics`` map) is read with an
explicit schema and exploded to the same two tables; its ``week`` holds the run's
date.  It is written as *bundles*, files of a line per subject, whose number follows
the data; files of one subject's array each, as other tools write them, are read too.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.timeparse import week_start
from pulsegrid.session import materialize
from pulsegrid.sources.tables import read_if_present
from pulsegrid.sources.xml import subject_of

RUN_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("report_date", T.DateType()),
    T.StructField("week", T.DateType()), T.StructField("generated_at", T.StringType()),
    T.StructField("run_number", T.LongType()), T.StructField("anomaly_count", T.LongType()),
    T.StructField("workout_count", T.LongType()), T.StructField("workout_duration_hrs", T.DoubleType()),
    T.StructField("workouts_in_week", T.LongType()), T.StructField("sleep_avg_hrs", T.DoubleType()),
])
METRIC_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("report_date", T.DateType()),
    T.StructField("week", T.DateType()), T.StructField("metric", T.StringType()), T.StructField("avg", T.DoubleType()),
    T.StructField("current", T.DoubleType()), T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()), T.StructField("avg_90d", T.DoubleType()),
    T.StructField("direction", T.StringType()), T.StructField("unit", T.StringType()),
])
METRIC_STRUCT = T.StructType([f for f in METRIC_SCHEMA.fields if f.name not in ("subject_id", "report_date", "week", "metric")])
JSON_SCHEMA = T.StructType([
    T.StructField("week", T.StringType()), T.StructField("generated_at", T.StringType()),
    T.StructField("run_number", T.LongType()),
    T.StructField("metrics", T.MapType(T.StringType(), METRIC_STRUCT)),
    T.StructField("anomaly_count", T.LongType()), T.StructField("workout_count", T.LongType()),
    T.StructField("workout_duration_hrs", T.DoubleType()), T.StructField("sleep_avg_hrs", T.DoubleType()),
])


STATE_SCHEMA = "subject_id long, last_number long, last_date date"
SAVES_SCHEMA = "number long, phase string, state string"
BUNDLE_SCHEMA = T.StructType([T.StructField("subject_id", T.LongType()), T.StructField("history", T.ArrayType(JSON_SCHEMA))])


def _stored(spark: SparkSession, path: str, table: str, schema: T.StructType) -> DataFrame:
    found = read_if_present(lambda: spark.read.schema(schema).parquet(os.path.join(path, table)))
    return spark.createDataFrame([], schema) if found is None else found


def load_snapshots(spark: SparkSession, path: str):
    """(snapshot_metric, snapshot_run); empty tables when nothing is stored."""
    return _stored(spark, path, "metrics", METRIC_SCHEMA), _stored(spark, path, "runs", RUN_SCHEMA)


def load_snapshots_json(spark: SparkSession, path: str):
    """S7 for the JSON history: bundles, files of one subject's array each, or
    both; missing path -> empty, corrupt objects are skipped."""
    parts = []
    bundles = read_if_present(lambda: spark.read.option("mode", "DROPMALFORMED").schema(BUNDLE_SCHEMA).json(os.path.join(path, "bundles")))
    if bundles is not None:
        parts.append(bundles.select("subject_id", F.explode("history").alias("d")).select("subject_id", "d.*"))
    single = os.path.join(path, "subject=*") if parts else path
    arrays = read_if_present(lambda: spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").schema(JSON_SCHEMA).json(single))
    if arrays is not None:
        parts.append(arrays.select(subject_of(F.col("_metadata.file_path")).cast("bigint").alias("subject_id"), *JSON_SCHEMA.fieldNames()))
    if not parts:
        return (spark.createDataFrame([], METRIC_SCHEMA), spark.createDataFrame([], RUN_SCHEMA))
    raw = (reduce(DataFrame.unionByName, parts)
           .withColumn("report_date", F.to_date(F.substring("week", 1, 10)))
           .where(F.col("report_date").isNotNull())
           .withColumn("week", week_start("report_date"))
           .withColumn("workouts_in_week", F.lit(None).cast("bigint")))
    runs = raw.select(*RUN_SCHEMA.fieldNames())
    metrics = (raw.select("subject_id", "report_date", "week", F.explode("metrics").alias("metric", "m"))
               .select("subject_id", "report_date", "week", "metric", "m.*"))
    return metrics, runs


def to_json_documents(metric: DataFrame, run: DataFrame) -> DataFrame:
    """Back to one nested document per snapshot (metrics as a map), with
    ``week`` as the JSON history writes it: the run's date."""
    nested = (metric.groupBy("subject_id", "report_date")
              .agg(F.map_from_entries(F.collect_list(F.struct(
                  "metric", F.struct(*[c.name for c in METRIC_STRUCT.fields])))).alias("metrics")))
    docs = run.join(nested, ["subject_id", "report_date"], "left")
    return docs.select("subject_id", F.date_format("report_date", "yyyy-MM-dd").alias("week"), "generated_at", "run_number",
                       "metrics", "anomaly_count", "workout_count", "workout_duration_hrs", "sleep_avg_hrs")


def _histories(metric: DataFrame, run: DataFrame) -> DataFrame:
    """A subject's documents as one array, oldest first (a document per run)."""
    docs = to_json_documents(metric, run)
    fields = F.struct("week", *[c for c in docs.columns if c not in ("subject_id", "week")])
    # In order of the run's date; maps have no order, so they stay out of the sort.
    return docs.groupBy("subject_id").agg(
        F.array_sort(F.collect_list(fields), lambda a, b: F.when(a["week"] < b["week"], -1).when(a["week"] > b["week"], 1).otherwise(0))
        .alias("history"))


def write_snapshots_json(metric: DataFrame, run: DataFrame, path: str) -> None:
    """The JSON history as bundles: a line per subject with its documents,
    many subjects a file, the files sized by the shuffle's partitions."""
    _histories(metric, run).hint("rebalance").write.json(os.path.join(path, "bundles"))


def write_snapshots_json_files(metric: DataFrame, run: DataFrame, path: str) -> None:
    """N2 for exchange with other tools: one array of documents per subject in a
    file of its own under ``subject=<id>``; meant for few subjects."""
    listed = _histories(metric, run).select(F.col("subject_id").alias("subject"), F.to_json("history").alias("value"))
    listed.write.partitionBy("subject").text(path)


def _last_numbers(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The number of the last save and the state it left: from its table, or,
    after a save that failed or in a store without a log, from all runs."""
    log = read_if_present(lambda: spark.read.schema(SAVES_SCHEMA).json(os.path.join(path, "log")))
    # Of the lines of one save the last written is "done".
    last = None if log is None else log.orderBy(F.desc("number"), F.desc(F.col("phase") == "done"), "state").first()
    if last is not None and last["phase"] == "done":
        return last["number"], spark.read.schema(STATE_SCHEMA).parquet(os.path.join(path, last["state"]))
    runs = _stored(spark, path, "runs", RUN_SCHEMA)
    state = runs.groupBy("subject_id").agg(F.max("run_number").alias("last_number"), F.max("report_date").alias("last_date"))
    return (last["number"] if last else 0), state


def _log(spark: SparkSession, path: str, number: int, phase: str, state: str) -> None:
    spark.createDataFrame([(number, phase, state)], SAVES_SCHEMA).coalesce(1).write.mode("append").json(os.path.join(path, "log"))


def save_snapshot(spark: SparkSession, metric: DataFrame, run: DataFrame, path: str):
    """Upsert the snapshot rows of the given report dates.

    ``run`` may lack ``run_number``; it is assigned here, to several new dates
    of one subject in their order.  Read are the state and the runs and metrics of
    these dates.  Returns the stored (snapshot_metric, snapshot_run) rows of these dates.
    """
    old_metric, old_run = load_snapshots(spark, path)
    save, state = _last_numbers(spark, path)
    new_run = materialize(run.drop("run_number"), "snapshot-run")
    # A weekly job saves one date, an import as many as its history has weeks.
    dates = [r[0] for r in new_run.select("report_date").distinct().collect()]
    key = ["subject_id", "report_date"]
    touched_run = old_run.where(F.col("report_date").isin(dates))
    touched_metric = old_metric.where(F.col("report_date").isin(dates))
    kept = touched_run.select(*key, F.col("run_number").alias("_kept"))
    top = state.select("subject_id", F.col("last_number").alias("_top"))
    fresh = F.sum(F.when(F.col("_kept").isNull(), 1).otherwise(0)).over(Window.partitionBy("subject_id").orderBy("report_date"))
    numbered = (new_run.join(kept, key, "left").join(top, "subject_id", "left")
                .withColumn("run_number", F.coalesce("_kept", F.coalesce("_top", F.lit(0)) + fresh).cast("bigint"))
                .select(*RUN_SCHEMA.fieldNames()))
    # Other subjects' rows of the touched dates survive the partition rewrite.
    other_runs = touched_run.join(new_run.select(*key), key, "left_anti").select(*RUN_SCHEMA.fieldNames())
    other_metrics = touched_metric.join(new_run.select(*key), key, "left_anti").select(*METRIC_SCHEMA.fieldNames())
    runs_out = materialize(numbered.unionByName(other_runs), "snapshot-runs")
    metrics_out = materialize(metric.select(*METRIC_SCHEMA.fieldNames()).unionByName(other_metrics), "snapshot-metrics")
    own = runs_out.select("subject_id", F.col("run_number").alias("last_number"), F.col("report_date").alias("last_date"))
    after = state.unionByName(own).groupBy("subject_id").agg(F.max("last_number").alias("last_number"), F.max("last_date").alias("last_date"))
    folder = f"state/save={save + 1}-{uuid.uuid4().hex}"
    after.write.parquet(os.path.join(path, folder))
    _log(spark, path, save + 1, "begun", folder)
    for table, rows in (("runs", runs_out), ("metrics", metrics_out)):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("report_date").parquet(os.path.join(path, table)))
    _log(spark, path, save + 1, "done", folder)
    return metrics_out, runs_out
