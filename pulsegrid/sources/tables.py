"""Parquet tables of the typed data (S3, S4, K1): bucketed parts and a log.

Subjects are dealt to a fixed number of buckets by a hash.  A commit writes one
*part*: ``<table>/part=<name>/bucket=<k>/…`` for records, workouts and the manifest
of the exports behind them, in the buckets that it touches only.  It then adds a
line to ``current`` that lists the parts that are live in every bucket.  A reader
follows the last line, so it sees all three tables of one commit; a job that
fails before that line has changed nothing.

Two kinds of commit:

* ``write_version`` replaces whole buckets: those of its manifest's subjects;
* ``append_part`` adds a part to the buckets it has rows for and reads nothing.  A
  subject may then have rows in several parts; its rows are those of its newest
  export (time, then path), resolved at reading.  ``compact`` rewrites such buckets.

Records are partitioned by ``metric`` below the bucket (a metric subset is read by
partition pruning) and sorted within files by (metric, subject_id, start_ts).
They are dealt to tasks by ``rebalance``, which splits a metric or a subject of any size.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.model import RECORDS_SCHEMA, WORKOUTS_SCHEMA

MANIFEST_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()), T.StructField("length", T.LongType()),
])
TABLES = {"records": RECORDS_SCHEMA, "workouts": WORKOUTS_SCHEMA, "manifest": MANIFEST_SCHEMA}
ORDER = {"records": ["metric", "subject_id", "start_ts"], "workouts": ["subject_id", "start_ts"], "manifest": ["subject_id"]}
LOG_SCHEMA = "number long, buckets int, live array<struct<table:string,bucket:int,part:string>>"

#: Buckets of a new store; an existing one keeps its number.
BUCKETS = 64


class Version(NamedTuple):
    number: int
    buckets: int
    live: frozenset[tuple[str, int, str]]  # (table, bucket, part)

    def parts(self, bucket: int) -> set[str]:
        return {part for table, b, part in self.live if b == bucket and table == "manifest"}


def read_if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its path doesn't exist: the listing
    that the reader needs anyhow tells."""
    try:
        return read()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_version(spark: SparkSession, path: str) -> Version | None:
    """The last complete commit, if there is one."""
    log = read_if_present(lambda: spark.read.schema(LOG_SCHEMA).json(os.path.join(path, "current")))
    row = None if log is None else log.orderBy(F.desc("number"), F.to_json("live")).first()
    return row and Version(row["number"], row["buckets"], frozenset((e["table"], e["bucket"], e["part"]) for e in row["live"]))


def bucket_of(subject: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(subject), F.lit(buckets)).cast("int")


def _write_part(path: str, part: str, tables: dict[str, DataFrame], buckets: int) -> set[tuple[str, int, str]]:
    """Write the part's tables; which buckets each has rows in, seen by the write
    itself.  The same part written again replaces itself."""
    wrote = set()
    for table, df in tables.items():
        seen, by = Observation(), ["bucket", "metric"] if table == "records" else ["bucket"]
        rows = df.select(*TABLES[table].fieldNames(), bucket_of(F.col("subject_id"), buckets).alias("bucket"))
        (rows.hint("rebalance", *map(F.col, by)).observe(seen, F.collect_set("bucket").alias("buckets"))
         .sortWithinPartitions("bucket", *ORDER[table]).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(*by).parquet(os.path.join(path, table, f"part={part}")))
        wrote |= {(table, b, part) for b in seen.get.get("buckets") or []}
    return wrote


def _commit(spark: SparkSession, path: str, number: int, buckets: int, live: set[tuple[str, int, str]]) -> None:
    # An appended file is committed as a whole; nothing is replaced.
    row = (number, buckets, [dict(zip(("table", "bucket", "part"), e)) for e in sorted(live)])
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").json(os.path.join(path, "current"))


def write_version(spark: SparkSession, path: str, records: DataFrame, workouts: DataFrame, manifest: DataFrame,
                  whole: bool = False, buckets: int = BUCKETS) -> str:
    """S3: a commit that replaces the buckets of the manifest's subjects, or, if
    ``whole``, the store; the part's name.  The tables must hold all rows of these buckets."""
    last = current_version(spark, path)
    buckets = last.buckets if last else buckets
    part = f"v-{uuid.uuid4().hex}"
    wrote = _write_part(path, part, {"records": records, "workouts": workouts, "manifest": manifest}, buckets)
    touched = {b for table, b, _ in wrote if table == "manifest"}
    kept = {e for e in last.live if e[1] not in touched} if last and not whole else set()
    _commit(spark, path, 1 + (last.number if last else 0), buckets, kept | wrote)
    return part


def append_part(spark: SparkSession, path: str, part: str, records: DataFrame, workouts: DataFrame, manifest: DataFrame,
                buckets: int = BUCKETS) -> bool:
    """A commit that adds ``part`` and reads no other; False if that part is
    already committed, so a batch that comes again adds nothing."""
    last = current_version(spark, path)
    if last and any(e[2] == part for e in last.live):
        return False
    buckets = last.buckets if last else buckets
    wrote = _write_part(path, part, {"records": records, "workouts": workouts, "manifest": manifest}, buckets)
    _commit(spark, path, 1 + (last.number if last else 0), buckets, (last.live if last else set()) | wrote)
    return True


def compact(spark: SparkSession, path: str, least: int = 2) -> list[int]:
    """Rewrite the buckets with at least ``least`` live parts as one part each;
    these buckets.  Readers see the same rows before and after."""
    last = current_version(spark, path)
    if last is None:
        return []
    count = Counter(b for table, b, _ in last.live if table == "manifest")
    many = sorted(b for b, n in count.items() if n >= least)
    if many:
        write_version(spark, path, read_records(spark, path, buckets=many), read_workouts(spark, path, many), read_manifest(spark, path, many))
    return many


def _version(spark: SparkSession, path: str) -> Version:
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no ingested tables at {path}")
    return version


def _parts(spark: SparkSession, path: str, table: str, version: Version, mixed: bool, buckets) -> DataFrame:
    """The rows of the buckets with one part, or (``mixed``) of those with several."""
    schema = T.StructType([*TABLES[table], T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
    count = Counter(b for t, b, _ in version.live if t == "manifest")
    paths = [os.path.join(path, t, f"part={p}", f"bucket={b}") for t, b, p in sorted(version.live)
             if t == table and (count[b] > 1) == mixed and (buckets is None or b in buckets)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", os.path.join(path, table)).parquet(*paths)


def _read(spark: SparkSession, path: str, table: str, buckets=None) -> DataFrame:
    """The table as of the last commit.  Buckets of one part are read as they
    are; in the others the rows of a subject's newest export count."""
    version, names = _version(spark, path), TABLES[table].fieldNames()
    plain = _parts(spark, path, table, version, False, buckets).select(*names)
    if not any(n > 1 for n in Counter(b for t, b, _ in version.live if t == "manifest").values()):
        return plain
    newest = _parts(spark, path, "manifest", version, True, buckets).groupBy("subject_id").agg(
        F.max(F.struct("mtime", "path", "part"))["part"].alias("part"))
    mixed = _parts(spark, path, table, version, True, buckets).join(newest, ["subject_id", "part"], "left_semi")
    return plain.unionByName(mixed.select(*names))


def read_records(spark: SparkSession, path: str, metrics=None, buckets=None) -> DataFrame:
    """Typed records; ``metrics`` prunes partitions, ``buckets`` folders."""
    df = _read(spark, path, "records", buckets)
    return df if metrics is None else df.where(F.col("metric").isin(*metrics))


def read_workouts(spark: SparkSession, path: str, buckets=None) -> DataFrame:
    return _read(spark, path, "workouts", buckets)


def read_manifest(spark: SparkSession, path: str, buckets=None) -> DataFrame:
    """The export behind each subject's rows."""
    return _read(spark, path, "manifest", buckets)
