"""Ingest job (C1 / S6): XML exports -> typed, bucketed Parquet tables.

An export holds its subject's whole history, so a subject's rows are those of its
newest export (modification time, then path): a re-export replaces them, an older
file that lands late doesn't.  The manifest of the tables tells which export each
subject's rows come from; the job lists the exports, takes by anti join the
subjects whose newest one isn't in the manifest (by path, time and length), parses
those files only, in one scan, and rewrites the buckets of those subjects: their
new rows and the other subjects' old ones.  All other buckets stay as they are.
A bundle's exports are known only when it is parsed; the bundles that were parsed are
noted beside the tables (``bundles``), so each is opened once.
``force`` parses all and takes nothing over.  Until the commit readers see the old
tables, so a failed job is just run again.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.model import MetricDim
from pulsegrid.operators.typing import type_records, type_workouts
from pulsegrid.session import materialize
from pulsegrid.sources.tables import (
    BUCKETS, append_part, bucket_of, current_version, read_if_present, read_manifest, read_records, read_workouts, write_version,
)
from pulsegrid.sources.xml import exports, exports_in, is_bundle, parse, records_of, uncommented, workouts_of

BUNDLES_SCHEMA = "path string, mtime timestamp, length long"
NOTHING = {"records_seen": 0, "kept": 0, "skipped": 0, "workouts": 0}


def newest_exports(files: DataFrame) -> DataFrame:
    """Per subject its newest file (columns of the manifest)."""
    top = files.groupBy("subject_id").agg(F.max(F.struct("mtime", "path", "length")).alias("f"))
    return top.select("subject_id", "f.path", "f.mtime", "f.length")


def ingest(spark: SparkSession, src: str, dst: str, force: bool = False, dim: MetricDim | None = None,
           subject: int | None = None, category_codes: dict | None = None, buckets: int = BUCKETS) -> dict:
    """Bring the tables under ``dst`` up to the exports under ``src`` (a folder
    or one file).  ``subject``: id of an export whose path names none.
    ``category_codes``: the opt-in of D2 (sleep category text -> stage code).
    ``buckets``: of a store that doesn't exist yet.

    Returns the S10 counters of the files parsed (elements seen, kept, skipped,
    workouts) and the ``mode``: full, update or unchanged.
    """
    listed = read_if_present(lambda: exports(spark, src, subject))
    if listed is None:
        raise FileNotFoundError(f"health export not found at {src}")
    old = not force and current_version(spark, dst) is not None
    file, key = ["path", "mtime", "length"], ["subject_id", "path", "mtime", "length"]
    single, bundles = listed.where("subject_id IS NOT NULL"), listed.where("subject_id IS NULL")
    if old:
        held = read_manifest(spark, dst)
        # What is held of a bundle that is still there stands against a single file of its subject.
        still = held.where(is_bundle(F.col("path"))).join(bundles.select(file), file, "left_semi")
        single = newest_exports(single.unionByName(still)).join(held, key, "left_anti")
        seen = read_if_present(lambda: spark.read.schema(BUNDLES_SCHEMA).parquet(os.path.join(dst, "bundles")))
        bundles = bundles if seen is None else bundles.join(seen, file, "left_anti")
    else:
        single = newest_exports(single)
    files = materialize(single.unionByName(bundles), "exports")
    second_before = F.date_format(F.min("mtime") - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss")
    count, since, bundled = files.agg(F.count(F.lit(1)), second_before, F.count_if(F.col("subject_id").isNull())).first()
    if old and not count:
        return NOTHING | {"mode": "unchanged"}
    if not count:
        raise FileNotFoundError(f"no export files under {src}")
    parsed = materialize(parse(spark, src, files, count, since, subject), "elements")
    data, newest = uncommented(parsed), files
    if bundled:
        found = exports_in(parsed, data).unionByName(files.where("subject_id IS NOT NULL"))
        if old:  # a late bundle of older exports changes nothing
            found = found.unionByName(held.join(listed.select(file), file, "left_semi").select(key))
        newest = newest_exports(found)
        newest = materialize(newest.join(held, key, "left_anti") if old else newest, "newest")
        data = data.join(newest.select("subject_id", "path"), ["subject_id", "path"], "left_semi")
    counts = merge(spark, data, newest, dst, dim, category_codes, old, buckets)
    if bundled:
        files.where("subject_id IS NULL").select(file).coalesce(1).write.mode("append").parquet(os.path.join(dst, "bundles"))
    return counts | {"mode": "update" if old else "full"}


class Counted:
    """Records and workouts of the elements, counted (S10) by the pass that writes them."""

    def __init__(self, data: DataFrame, dim: MetricDim, category_codes: dict | None):
        raw, works = records_of(data), workouts_of(data)
        seen = [F.count(F.lit(1)).alias("records_seen"), F.count(dim.metric_for_type(F.col("type"))).alias("kept")]
        self.sides = [(raw, seen, Observation()), (works, [F.count(F.lit(1)).alias("workouts")], Observation())]
        raw, works = (df.observe(o, *what) for df, what, o in self.sides)
        self.records, self.workouts = type_records(raw, dim, category_codes), type_workouts(works)

    def counters(self) -> dict:
        """After the write."""
        out = dict(NOTHING)
        for df, what, observation in self.sides:
            try:
                got = observation.get
            except Py4JJavaError:  # nothing was left to write, so the plan was cut short and has no counts
                got = df.agg(*what).first().asDict()
            out |= got
        return out | {"skipped": out["records_seen"] - out["kept"]}


def merge(spark: SparkSession, data: DataFrame, newest: DataFrame, dst: str, dim: MetricDim | None = None,
          category_codes: dict | None = None, old: bool = True, buckets: int = BUCKETS) -> dict:
    """A commit under ``dst``: the elements ``data`` for the subjects of
    ``newest`` and, with ``old``, the present rows of the others in their buckets."""
    counted = Counted(data, dim or MetricDim.health(), category_codes)
    records, workouts = counted.records, counted.workouts
    manifest = newest.select("subject_id", "path", "mtime", "length")
    version = current_version(spark, dst) if old else None
    if version is None:
        write_version(spark, dst, records, workouts, manifest, whole=True, buckets=buckets)
        return counted.counters()
    touched = [r[0] for r in newest.select(bucket_of(F.col("subject_id"), version.buckets)).distinct().collect()]
    replaced = newest.select("subject_id").distinct()
    kept = lambda table: table.join(replaced, "subject_id", "left_anti")
    write_version(spark, dst, records.unionByName(kept(read_records(spark, dst, buckets=touched))),
                  workouts.unionByName(kept(read_workouts(spark, dst, touched))),
                  manifest.unionByName(kept(read_manifest(spark, dst, touched))))
    return counted.counters()


def append(spark: SparkSession, data: DataFrame, newest: DataFrame, dst: str, part: str, dim: MetricDim | None = None,
           category_codes: dict | None = None, buckets: int = BUCKETS) -> dict:
    """A commit that adds the elements ``data`` of the exports ``newest`` as
    ``part``, reading nothing; no counts if that part is already there."""
    counted = Counted(data, dim or MetricDim.health(), category_codes)
    records, workouts = counted.records, counted.workouts
    manifest = newest.select("subject_id", "path", "mtime", "length")
    added = append_part(spark, dst, part, records, workouts, manifest, buckets)
    return counted.counters() if added else dict(NOTHING)
