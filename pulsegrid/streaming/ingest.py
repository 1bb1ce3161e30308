"""Incremental ingest as Structured Streaming (S5 re-aimed).

A file-source stream over the landing folder with ``trigger(availableNow=True)``:
each run takes the export files that arrived since the last one (tracked in the
checkpoint) and stops.  Each micro-batch is parsed by the batch job's parser and
*appended* to the tables as a part of its own, named by stream and batch: what a
batch writes is in proportion to the batch, and nothing is read.  Which export of
a subject counts is resolved at reading (newest time, then path), so a late older
file changes nothing.  A batch that comes again after a failure writes the same part
over, and one that was committed adds nothing.  Buckets that have gathered
many parts are rewritten after the stream has stopped.

The file source knows files by path: a re-export must land under a new name
(``subject=<id>/<date>.xml``).  Files rewritten in place are for the batch job,
which compares times and lengths.

Row-based rolling windows are not streaming operators in Spark, so analysis
runs as batch on the written tables (or per micro-batch in ``foreachBatch``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.model import MetricDim
from pulsegrid.operators.typing import type_records
from pulsegrid.plans.ingest import NOTHING, append, newest_exports
from pulsegrid.session import materialize
from pulsegrid.sources.tables import BUCKETS, compact
from pulsegrid.sources.xml import elements, exports_in, records_of, scan, uncommented

#: Live parts in a bucket from which on it is rewritten as one.
COMPACT_PARTS = 16


def ingest_available(spark: SparkSession, landing: str, dst: str, checkpoint: str, dim: MetricDim | None = None,
                     subject: int | None = None, category_codes: dict | None = None, buckets: int = BUCKETS,
                     files_per_batch: int | None = None, compact_parts: int = COMPACT_PARTS) -> dict:
    """Append the files not yet seen to the tables under ``dst`` and stop; the
    S10 counters of what was appended.  ``files_per_batch`` bounds a micro-batch."""
    total = dict(NOTHING)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def appended(batch: DataFrame, number: int) -> None:
        parsed = materialize(elements(batch, subject), "elements")
        data = uncommented(parsed)
        newest = materialize(newest_exports(exports_in(parsed, data)), "exports")
        data = data.join(newest.select("subject_id", "path"), ["subject_id", "path"], "left_semi")
        for name, n in append(spark, data, newest, dst, f"s-{stream}-{number}", dim, category_codes, buckets).items():
            total[name] += n

    files = scan(spark, landing, stream=True, files_per_batch=files_per_batch)
    query = (files.writeStream.foreachBatch(appended)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    compact(spark, dst, compact_parts)
    return total


def daily_stream(spark: SparkSession, landing: str, dim: MetricDim | None = None,
                 watermark: str = "2 days") -> DataFrame:
    """Optional streaming daily mean per (subject, metric, day) with a
    watermark on the reading time, for dashboards that want partial days.  Rows
    of a stream have no order, so comments aren't recognised here."""
    dim = dim or MetricDim.health()
    typed = type_records(records_of(elements(scan(spark, landing, stream=True), ordered=False)), dim)
    return (typed.where(F.col("start_ts").isNotNull())
            .withWatermark("start_ts", watermark)
            .groupBy("subject_id", "metric", F.window("start_ts", "1 day"))
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")))
