"""Report sinks (S11, S12): report tables as Parquet (or CSV) under a folder.

The Markdown notes themselves are not built (text layout); these tables hold
every value a note would show.  A report is written as a whole for its report
date, ``<name>/report_date=<date>``, with its subjects sorted inside the files:
a subject that left isn't in it, a report without rows still has its schema, and
the number of files follows the data, not the subjects.  ``out_of_order`` checks
the order of what was written, by the place of the rows in their files.

The metric log is an upsert keyed by (subject, metric, date) in three folders of
``metric_log``: ``rows`` has the reports' rows, a partition per report date;
``history/fill=<name>`` the back-fill of the pages that began with one run; and
``pages`` is the registry of the pages there are, one small row each, with the name
of their back-fill.  A run reads the registry and the rows of its own date; what it
writes are these rows, and the back-fill and registry rows of new pages only.  The
registry is written last and alone says which back-fill counts: a run that failed
before finds its pages new again.
Where a report's row meets a back-filled point, the report's row counts.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.model import SERIES_KEY
from pulsegrid.session import materialize
from pulsegrid.sources.tables import read_if_present

PAGES_SCHEMA = "subject_id long, metric string, since date, fill string"
LOG_SCHEMA = "subject_id long, metric string, value double, unit string, trend string, arrow string, date date"


def write_report(df: DataFrame, root: str, name: str, report_date=None, fmt: str = "parquet", order_by=None) -> str:
    """Write one report table for ``report_date`` (null: a table without dates),
    replacing what was there for it.  ``order_by`` is the presentation order
    (K2-K4; "-name" descending), applied within each output file only -- no global sort."""
    path = os.path.join(root, name)
    if report_date is not None:
        path = os.path.join(path, f"report_date={report_date}")
    if order_by:
        df = df.sortWithinPartitions(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order_by])
    # Static overwrite whatever the session says: the folder is this report alone.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def read_report(spark: SparkSession, root: str, name: str, report_date=None) -> DataFrame:
    """The report of one date, or of all with their ``report_date``."""
    path = os.path.join(root, name)
    return spark.read.parquet(path if report_date is None else os.path.join(path, f"report_date={report_date}"))


def out_of_order(rows: DataFrame, order_by: list[str]) -> DataFrame:
    """K1-K4 as a checked fact: one row with ``n_rows`` and ``n_out_of_order``, the
    rows of the Parquet files behind ``rows`` (as read, not yet joined or grouped)
    that sort before the row just before them in the same file.  The place is that
    of the file itself, so the result doesn't depend on how it is read.
    Descending columns ("-name") must be numbers."""
    keys = [F.negative(c[1:]) if c.startswith("-") else F.col(c) for c in order_by]
    placed = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), F.struct(*keys).alias("key"))
    wrong = F.lag("key").over(Window.partitionBy("file").orderBy("place")) > F.col("key")
    return placed.select(wrong.alias("wrong")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.count_if("wrong"), F.lit(0)).alias("n_out_of_order"))


def _log_rows(spark: SparkSession, root: str) -> DataFrame | None:
    return read_if_present(lambda: spark.read.schema(LOG_SCHEMA).parquet(os.path.join(root, "metric_log", "rows")))


def read_metric_pages(spark: SparkSession, root: str) -> DataFrame | None:
    """The registry: every series with a page, the report date it began with and
    the folder of its back-fill."""
    return read_if_present(lambda: spark.read.schema(PAGES_SCHEMA).parquet(os.path.join(root, "metric_log", "pages")))


def read_metric_log(spark: SparkSession, root: str) -> DataFrame | None:
    """The log, one row per (subject, metric, date)."""
    pages, rows = read_metric_pages(spark, root), _log_rows(spark, root)
    if pages is None:
        return rows
    # A folder for each run that began pages.
    fills = sorted(r["fill"] for r in pages.select("fill").distinct().collect())
    history = spark.read.schema(LOG_SCHEMA).parquet(*[os.path.join(root, "metric_log", "history", f"fill={f}") for f in fills])
    if rows is None:
        return history
    reported = rows.select(*SERIES_KEY, "date")
    return rows.unionByName(history.join(reported, [*SERIES_KEY, "date"], "left_anti").select(*rows.columns))


def write_metric_log(spark: SparkSession, rows: DataFrame, root: str, report_date=None) -> str:
    """Upsert ``rows`` (``metric_log_rows`` with the registry, or with the log) of
    one run; ``report_date`` is noted in the registry."""
    path = os.path.join(root, "metric_log")
    columns = ["subject_id", "metric", "value", "unit", "trend", "arrow", "date"]
    rows = materialize(rows.select(*columns), "metric-log-rows")
    pages = read_metric_pages(spark, root)
    history = rows
    if pages is not None:
        known = pages.select(*SERIES_KEY).distinct()
        history, own = rows.join(known, SERIES_KEY, "left_anti"), rows.join(known, SERIES_KEY, "left_semi")
        old = _log_rows(spark, root)
        if old is not None:  # rows of this date whose series aren't reported again stay
            dates = [r["date"] for r in own.select("date").distinct().collect()]  # a run reports one date
            old = old.where(F.col("date").isin(dates))
            own = own.unionByName(old.join(own, [*SERIES_KEY, "date"], "left_anti").select(*own.columns))
        own = materialize(own.select(*columns), "metric-log")
        (own.hint("rebalance").sortWithinPartitions(*SERIES_KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(os.path.join(path, "rows")))
    new = materialize(history.select(*SERIES_KEY).distinct(), "metric-log-pages")
    if not new.isEmpty():
        day = None if report_date is None else str(report_date)
        fill = f"{day or 'run'}-{uuid.uuid4().hex}"
        (history.select(*columns).hint("rebalance").sortWithinPartitions("date", *SERIES_KEY)
         .write.parquet(os.path.join(path, "history", f"fill={fill}")))
        began = new.select(*SERIES_KEY, F.lit(day).cast("date").alias("since"), F.lit(fill).alias("fill"))
        began.coalesce(1).write.mode("append").parquet(os.path.join(path, "pages"))
    return path
