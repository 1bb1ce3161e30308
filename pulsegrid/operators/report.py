"""Report tables (C13: J10, P15, P16, K5, W11, A20, F17-F22, F24, F25, S12).

The reports are tables (Parquet/CSV sinks in ``sources.reports``), not
Markdown: one row per line a note would show.  The text context (F22) is
built per subject with ``collect_list`` of (position, line) structs; a
subject's lines are bounded by its metrics, five anomalies per metric and
four correlations, so the grouped list never grows with the raw data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import arrow_class, callout_class, display_name, safe_name
from pulsegrid.functions.rounding import half_up
from pulsegrid.model import ANOMALY_THRESHOLD, REPORT_ANOMALY_DAYS, SERIES_KEY, SLEEP_DURATION_METRIC, MetricDim
from pulsegrid.operators.trend import as_date


def report_overview(trend: DataFrame, wow: DataFrame | None, dim: MetricDim) -> DataFrame:
    """J10 + P16 + F17-F19: one line per metric with enough data, with the
    week-over-week change when the previous snapshot has the metric."""
    t = trend.where(F.col("direction") != "insufficient_data")
    if wow is not None:
        t = t.join(wow.select(*SERIES_KEY, F.col("delta").alias("wow_delta"),
                              F.col("pct_change").alias("wow_pct_change"),
                              F.col("direction").alias("wow_direction")),
                   SERIES_KEY, "left")
    else:
        t = t.select("*", F.lit(None).cast("double").alias("wow_delta"),
                     F.lit(None).cast("double").alias("wow_pct_change"),
                     F.lit(None).cast("string").alias("wow_direction"))
    name = display_name(F.col("metric"))
    return t.select(
        *SERIES_KEY, name.alias("display_name"), safe_name(name).alias("page_name"),
        "current_value", dim.unit_expr(F.col("metric")).alias("unit"),
        arrow_class(F.col("direction")).alias("arrow"), "direction", "avg_90d",
        "wow_delta", "wow_pct_change", "wow_direction")


def report_anomalies(anomalies: DataFrame, as_of, days: int = REPORT_ANOMALY_DAYS,
                     threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """P15 + W11 + F20 + F21: anomalies of the last ``days`` days, numbered
    per subject newest first, with the signed deviation text and callout."""
    recent = anomalies.where(F.col("date") >= F.date_sub(as_date(as_of), days))
    w = Window.partitionBy("subject_id").orderBy(F.desc("date"), "metric")
    dev = F.col("deviation_sigma")
    return recent.select(
        "subject_id", F.row_number().over(w).cast("bigint").alias("row_no"), "metric",
        display_name(F.col("metric")).alias("display_name"),
        F.date_format("date", "yyyy-MM-dd").alias("date"), "value",
        dev.alias("deviation"),
        F.format_string("%+.2fσ", dev).alias("deviation_text"),
        callout_class(dev, threshold).alias("callout"), "severity")


def top_anomalies(anomalies: DataFrame, k: int = 5) -> DataFrame:
    """K5 + A20: per metric the anomaly count and the ``k`` most recent."""
    by_metric = Window.partitionBy(*SERIES_KEY)
    w = by_metric.orderBy(F.desc("date"))
    ranked = anomalies.select(*SERIES_KEY, "date", "value", "deviation_sigma",
                              F.row_number().over(w).alias("k"),
                              F.count(F.lit(1)).over(by_metric).alias("n_readings"))
    return ranked.where(F.col("k") <= k).select(
        *SERIES_KEY, F.col("k").cast("bigint").alias("k"), "date", "value", "deviation_sigma", "n_readings")


def metric_log_rows(rolling: DataFrame, trend: DataFrame, dim: MetricDim, report_date,
                    existing: DataFrame | None = None, backfill: int = 90) -> DataFrame:
    """The rows one run adds to the per-metric data log or replaces there.

    A series without rows in ``existing`` gets a new page: its last ``backfill``
    raw points with trend 'flat'.  A series with a page gets the report date's
    row.  Only metrics with enough data get a page, so each has raw points.
    """
    keep = trend.where(F.col("direction") != "insufficient_data").select(*SERIES_KEY, "current_value", "direction")
    if existing is None:
        paged = keep.select(*SERIES_KEY, F.lit(False).alias("_paged"))
    else:
        pages = existing.groupBy(*SERIES_KEY).agg(F.lit(True).alias("_paged"))
        paged = keep.select(*SERIES_KEY).join(pages, SERIES_KEY, "left").fillna(False, ["_paged"])
    keep = keep.join(paged, SERIES_KEY)
    rn = F.row_number().over(Window.partitionBy(*SERIES_KEY).orderBy(F.desc("date")))
    tail = rolling.select(*SERIES_KEY, "date", F.col("raw").alias("value"), rn.alias("_rn")).where(F.col("_rn") <= backfill)
    new = keep.where("NOT _paged").select(*SERIES_KEY)
    history = tail.join(new, SERIES_KEY, "left_semi").select(
        *SERIES_KEY, "date", half_up("value", 2).alias("value"), F.lit("flat").alias("trend"))
    own = keep.where("_paged").select(
        *SERIES_KEY, as_date(report_date).alias("date"), F.col("current_value").alias("value"), F.col("direction").alias("trend"))
    return history.unionByName(own).select(
        *SERIES_KEY, "date", "value", dim.unit_expr(F.col("metric")).alias("unit"), "trend",
        arrow_class(F.col("trend")).alias("arrow"))


def metric_log(rolling: DataFrame, trend: DataFrame, dim: MetricDim, report_date,
               existing: DataFrame | None = None, backfill: int = 90) -> DataFrame:
    """The whole log after a run, one row per (subject, metric, date)."""
    rows = metric_log_rows(rolling, trend, dim, report_date, existing, backfill)
    if existing is None:
        return rows
    old = existing.select(*rows.columns)
    return old.join(rows, [*SERIES_KEY, "date"], "left_anti").select(*rows.columns).unionByName(rows)


def _fmt1(c):
    return F.format_string("%.1f", half_up(c, 1))


def context_text(trend: DataFrame, anomalies: DataFrame, correlations: DataFrame,
                 date_range: DataFrame, per_metric: int = 5) -> DataFrame:
    """the data-context block per subject (trends, anomalies grouped by
    metric with the five most recent, correlations), as one text column."""
    # Trends: one line each.
    cur, avg90, pct = F.col("current_value"), F.col("avg_90d"), F.col("pct_vs_90d")
    t_line = F.concat(
        F.lit("• **"), F.col("metric"), F.lit("**: trend is **"), F.col("direction"), F.lit("**"),
        F.when(cur.isNotNull(), F.concat(F.lit(" (current: "), _fmt1(cur),
                                          F.when(avg90.isNotNull(), F.concat(F.lit(" vs 90d avg: "), _fmt1(avg90)))
                                          .otherwise(F.lit("")), F.lit(")"))).otherwise(F.lit("")),
        F.when(pct.isNotNull(), F.concat(F.lit(", "), F.format_string("%+.1f", half_up(pct, 1)),
                                         F.lit("% vs 90d avg"))).otherwise(F.lit("")))
    trends = trend.select("subject_id", F.lit(1).alias("sec"), "metric", F.lit(0).alias("k"), t_line.alias("line"))

    # Anomalies: header per metric, then up to ``per_metric`` newest entries.
    top = top_anomalies(anomalies, per_metric)
    head = (top.where(F.col("k") == 1)
            .select("subject_id", F.lit(2).alias("sec"), "metric", F.lit(0).alias("k"),
                    F.concat(F.lit("• **"), F.col("metric"), F.lit("** — "), F.col("n_readings").cast("string"),
                             F.lit(" anomalous reading(s):")).alias("line")))
    entries = top.select(
        "subject_id", F.lit(2).alias("sec"), "metric", F.col("k").cast("int").alias("k"),
        F.concat(F.lit("  – "), F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00: value="),
                 F.col("value").cast("string"),
                 F.when(F.col("deviation_sigma").isNotNull(),
                        F.concat(F.lit(" (z-score "), F.format_string("%+.2f", "deviation_sigma"), F.lit(")")))
                 .otherwise(F.lit(""))).alias("line"))

    # Correlations: r with 3 digits, 'nan' when undefined.
    r_txt = F.when(F.col("r").isNull(), F.lit("nan")).otherwise(F.format_string("%.3f", half_up("r", 3)))
    corr = correlations.select("subject_id", F.lit(3).alias("sec"), F.col("relationship").alias("metric"),
                               F.lit(0).alias("k"),
                               F.concat(F.lit("• **"), F.col("relationship"), F.lit("**: r = "), r_txt).alias("line"))

    # One row for the date range, then all lines of a subject meet once.
    span = date_range.select("subject_id", F.lit(0).alias("sec"), F.lit("").alias("metric"), F.lit(0).alias("k"),
                             F.concat(F.coalesce("start", F.lit("unknown")), F.lit(" to "),
                                      F.coalesce("end", F.lit("unknown"))).alias("line"))
    lines = trends.unionByName(head).unionByName(entries).unionByName(corr).unionByName(span)
    each = lines.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct("sec", "metric", "k", "line"))).alias("l"))

    def section(sec: int, otherwise: str):
        own = F.filter("l", lambda s: s["sec"] == sec)
        return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda s: s["line"]), "\n")).otherwise(F.lit(otherwise))

    # Fixed text: headings and fallbacks of the context.
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("## Data Context  (date range: "), section(0, "unknown to unknown"), F.lit(")")),
        F.lit(""), F.lit("### Trends"), section(1, "No trend data available."),
        F.lit(""), F.lit("### Anomalies"), section(2, "No anomalies detected."),
        F.lit(""), F.lit("### Correlations"), section(3, "No correlation data available."))
    return each.where(F.exists("l", lambda s: s["sec"] == 1)).select("subject_id", text.alias("text"))


def date_range_of(daily: DataFrame) -> DataFrame:
    """First and last day with readings per subject (the nightly sleep series
    is derived, and doesn't count)."""
    return daily.where(F.col("metric") != SLEEP_DURATION_METRIC).groupBy("subject_id").agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("start"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("end"))
