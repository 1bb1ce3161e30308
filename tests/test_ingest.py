import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.model import MetricDim
from pulsegrid.operators.typing import kept_skipped, type_records, type_workouts
from pulsegrid.sources.xml import _PLAIN, RECORD_ATTRS, WORKOUT_ATTRS, elements, read_records, read_workouts, scan

HEADER = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!ELEMENT HealthData (ExportDate,Me,(Record|Workout)*)>
]>
<HealthData locale="en_US">
 <ExportDate value="2024-01-20 09:00:00 -0600"/>
"""
FOOTER = "</HealthData>\n"


def rec(t, value, start, src="Watch", end=None, creation=None, children=""):
    attrs = f'type="{t}" sourceName="{src}" unit="x" '
    if creation is not False:
        attrs += f'creationDate="{creation or start}" '
    attrs += f'startDate="{start}" endDate="{end or start}"'
    if value is not None:
        attrs += f' value="{value}"'
    if children:
        return f" <Record {attrs}>\n{children}\n </Record>\n"
    return f" <Record {attrs}/>\n"


def edge_export():
    body = "".join([
        rec("HKQuantityTypeIdentifierRestingHeartRate", "55", "2024-01-15 08:30:00 -0600", src="Watch &amp; Co"),
        rec("HKQuantityTypeIdentifierStepCount", "1200", "2024-01-15 08:00:00 -0600",
            children='  <MetadataEntry key="HKWasUserEntered" value="1"/>'),
        rec("HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryValueSleepAnalysisAsleepCore",
            "2024-01-15 23:30:00 -0600", end="2024-01-16 06:30:00 -0600"),
        rec("HKQuantityTypeIdentifierDietaryWater", "250", "2024-01-15 10:00:00 -0600"),   # unregistered
        rec("HKQuantityTypeIdentifierHeartRate", "", "2024-01-15 11:00:00 -0600"),          # empty value
        rec("HKQuantityTypeIdentifierHeartRate", None, "2024-01-15 12:00:00 -0600"),        # missing value
        rec("HKQuantityTypeIdentifierHeartRate", "70", "bad", end="bad", creation="bad"),   # all dates bad
        rec("HKQuantityTypeIdentifierHeartRate", "71", "bad", end="2024-01-15 13:00:00 -0600",
            creation="2024-01-15 13:00:00 -0600"),                                          # only start bad
        rec("HKQuantityTypeIdentifierHeartRate", "72", "2024-07-15 13:00:00 -0500"),         # second offset
        rec("HKQuantityTypeIdentifierHeartRate", "73", "2024-01-14 23:30:00 -0600"),         # Sunday late
        ' <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="32.5" durationUnit="min" '
        'totalDistance="5.1" totalDistanceUnit="km" totalEnergyBurned="320" totalEnergyBurnedUnit="kcal" '
        'sourceName="Watch" creationDate="2024-01-14 19:00:00 -0600" startDate="2024-01-14 18:20:00 -0600" '
        'endDate="2024-01-14 18:52:30 -0600">\n  <WorkoutEvent type="Segment" date="2024-01-14 18:30:00 -0600"/>\n'
        ' </Workout>\n',
    ])
    return HEADER + body + FOOTER


@pytest.fixture()
def export_dir(tmp):
    d = os.path.join(tmp, "landing")
    os.makedirs(d)
    with open(os.path.join(d, "subject=7.xml"), "w") as f:
        f.write(edge_export())
    with open(os.path.join(d, "subject=8.xml"), "w") as f:
        f.write(HEADER + FOOTER)                       # an export with no records
    return d


def test_xml_scan_and_typing(spark, export_dir):
    raw = read_records(spark, export_dir)
    assert raw.count() == 10
    typed = type_records(raw, MetricDim.health())
    rows = typed.collect()
    assert len(rows) == 8                                # unregistered and all-bad-dates dropped
    by = {(r.metric, r.value) for r in rows}
    assert ("resting_heart_rate", 55.0) in by and ("step_count", 1200.0) in by
    assert ("sleep_analysis", None) in by                # category text -> NULL (D2)
    assert sum(1 for r in rows if r.metric == "heart_rate" and r.value is None) == 2
    src = {r.source_name for r in rows}
    assert "Watch & Co" in src
    bad_start = [r for r in rows if r.value == 71.0][0]
    assert bad_start.start_ts is None and bad_start.start_local is None and bad_start.end_ts is not None
    summer = [r for r in rows if r.value == 72.0][0]
    assert summer.start_local == dt.datetime(2024, 7, 15, 13, 0)
    assert summer.start_ts.replace(tzinfo=None) == dt.datetime(2024, 7, 15, 18, 0)
    assert {r.subject_id for r in rows} == {7}


def test_category_codes_opt_in(spark, export_dir):
    typed = type_records(read_records(spark, export_dir), MetricDim.health(),
                         category_codes={"HKCategoryValueSleepAnalysisAsleepCore": 3})
    assert typed.where("metric = 'sleep_analysis'").first().value == 3.0


def by_row_tag(spark, path, tag, attrs):
    """The same elements by Spark's XML source, a file per task."""
    df = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(
        ", ".join(f"_{a} string" for a in attrs)).load(path)
    return sorted(map(tuple, df.collect()), key=str)


def test_scan_equals_row_tag_source(spark, export_dir):
    got = sorted(map(tuple, read_records(spark, export_dir).drop("subject_id").collect()), key=str)
    assert got == by_row_tag(spark, export_dir, "Record", RECORD_ATTRS) and len(got) == 10
    got = sorted(map(tuple, read_workouts(spark, export_dir).drop("subject_id").collect()), key=str)
    assert got == by_row_tag(spark, export_dir, "Workout", WORKOUT_ATTRS) and len(got) == 1
    w = type_workouts(read_workouts(spark, export_dir)).first()
    assert (w.duration, w.total_distance, w.start_local) == (32.5, 5.1, dt.datetime(2024, 1, 14, 18, 20))


def test_one_file_is_split_and_no_row_is_long(spark, tmp):
    """Many records before the first workout, in a file of many splits."""
    d = os.path.join(tmp, "big")
    os.makedirs(d)
    n = 50_000
    body = "".join(rec("HKQuantityTypeIdentifierHeartRate", str(i), "2024-01-15 08:30:00 -0600",
                       children='  <MetadataEntry key="k" value="v"/>' if i % 3 == 0 else "")
                   for i in range(n))
    body += ' <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="1" startDate="2024-01-14 18:20:00 -0600"/>\n'
    with open(os.path.join(d, "subject=1.xml"), "w") as f:
        f.write(HEADER + body + FOOTER)
    from pulsegrid.sources.xml import elements, scan

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1048576")
    try:
        rows = scan(spark, d)
        assert rows.select("block").distinct().count() > 4
        assert rows.agg(F.max(F.length("value"))).first()[0] < 1_000
        seen = elements(rows).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("s")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.kind: (r.n, r.s) for r in seen if r.kind} == {"Record": (n, n * (n - 1) // 2), "Workout": (1, None)}


def test_references_and_comments(spark, tmp):
    d = os.path.join(tmp, "c")
    os.makedirs(d)
    at = "2024-01-15 08:30:00 -0600"
    heart = "HKQuantityTypeIdentifierHeartRate"
    body = "".join([
        rec(heart, "1", at, src="John&#8217;s &#x57;atch &amp;lt; &#38;amp; &unknown; &#55296; &#x1F600;"),
        "<!-- " + rec(heart, "2", at) + rec(heart, "3", at) + " -->\n", rec(heart, "4", at),
        "<!-- plain comment -->", rec(heart, "5", at), "<!--" + rec(heart, "6", at).strip() + "-->", rec(heart, "7", at),
    ])
    with open(os.path.join(d, "subject=5.xml"), "w") as f:
        f.write(HEADER + body + FOOTER)
    got = {r.value: r.sourceName for r in read_records(spark, d).collect()}
    assert set(got) == {"1", "4", "5", "7"}
    assert got["1"] == "John’s Watch &lt; &amp; &unknown; &#55296; \U0001F600"


def test_kept_skipped(spark, export_dir):
    got = {r.status: r.n_records for r in kept_skipped(read_records(spark, export_dir), MetricDim.health()).collect()}
    assert got == {"kept": 9, "skipped": 1}


def put(folder, name, *records, mtime=None):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(HEADER + "".join(records) + FOOTER)
    if mtime:
        os.utime(path, (mtime, mtime))
    return path


STEPS, HEART = "HKQuantityTypeIdentifierStepCount", "HKQuantityTypeIdentifierHeartRate"


def days(kind, values):
    return [rec(kind, str(v), f"2024-01-{k + 1:02d} 08:00:00 -0600") for k, v in enumerate(values)]


def stored(spark, dst):
    return sorted((r.subject_id, r.metric, r.value) for r in read_tables(spark, dst)[0].collect())


def read_tables(spark, dst):
    from pulsegrid.sources import tables

    return tables.read_records(spark, dst), tables.read_workouts(spark, dst)


def test_ingest_incremental(spark, tmp, export_dir):
    from pulsegrid.plans.ingest import ingest
    from pulsegrid.sources.tables import read_records

    dst = os.path.join(tmp, "tables")
    c1 = ingest(spark, export_dir, dst)
    assert (c1["records_seen"], c1["kept"], c1["skipped"], c1["workouts"], c1["mode"]) == (10, 9, 1, 1, "full")
    c2 = ingest(spark, export_dir, dst)
    assert c2["records_seen"] == 0 and c2["mode"] == "unchanged"
    put(export_dir, "subject=9.xml", rec("HKQuantityTypeIdentifierHRV", "1", "2024-01-15 08:30:00 -0600"),
        rec("HKQuantityTypeIdentifierHeartRateVariabilitySDNN", "48", "2024-01-15 08:30:00 -0600"), mtime=1_000_000)
    c3 = ingest(spark, export_dir, dst)  # landed late with an older time: still new
    assert (c3["records_seen"], c3["kept"], c3["mode"]) == (2, 1, "update")
    recs = read_records(spark, dst)
    assert recs.count() == 9
    assert read_records(spark, dst, ["hrv"]).collect()[0].subject_id == 9
    c4 = ingest(spark, export_dir, dst, force=True)
    assert c4["mode"] == "full" and read_records(spark, dst).count() == 9
    with pytest.raises(FileNotFoundError):
        ingest(spark, os.path.join(tmp, "nope"), dst)


def test_reexport_replaces_and_force_forgets(spark, tmp):
    from pulsegrid.plans.ingest import ingest

    src, dst = os.path.join(tmp, "landing"), os.path.join(tmp, "tables")
    put(src, "subject=1.xml", *days(STEPS, [100, 200]), *days(HEART, [60]), mtime=1_700_000_000)
    put(src, "subject=2/a.xml", *days(STEPS, [7]), mtime=1_700_000_000)
    ingest(spark, src, dst)
    put(src, "subject=1.xml", *days(STEPS, [100, 200, 300]), mtime=1_700_000_100)  # no heart rate any more
    put(src, "subject=2/old.xml", *days(STEPS, [1, 2]), mtime=1_600_000_000)  # older than what is held
    assert ingest(spark, src, dst)["records_seen"] == 3
    want = [(1, "step_count", 100.0), (1, "step_count", 200.0), (1, "step_count", 300.0), (2, "step_count", 7.0)]
    assert stored(spark, dst) == want
    assert ingest(spark, src, dst, force=True)["mode"] == "full" and stored(spark, dst) == want


def test_failure_before_the_end_changes_nothing(spark, tmp, monkeypatch):
    from pulsegrid.plans import ingest as job
    from pulsegrid.sources import tables

    src, dst = os.path.join(tmp, "landing"), os.path.join(tmp, "tables")
    put(src, "subject=1.xml", *days(STEPS, [1]), mtime=1_700_000_000)
    job.ingest(spark, src, dst)
    put(src, "subject=1.xml", *days(STEPS, [1, 2]), mtime=1_700_000_100)

    def broken(spark, path, records, workouts, manifest):
        records.write.parquet(os.path.join(path, "v-broken", "records"))
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(job, "write_version", broken)
        with pytest.raises(OSError):
            job.ingest(spark, src, dst)
    assert stored(spark, dst) == [(1, "step_count", 1.0)]
    job.ingest(spark, src, dst)
    assert stored(spark, dst) == [(1, "step_count", 1.0), (1, "step_count", 2.0)]
    assert tables.current_version(spark, dst)[0] == 2


def test_subjects_are_never_guessed(spark, tmp):
    from pulsegrid.plans.ingest import ingest

    one = put(os.path.join(tmp, "one"), "export_2024-01-15.xml", *days(STEPS, [5]))
    dst = os.path.join(tmp, "tables")
    ingest(spark, one, dst)
    assert stored(spark, dst) == [(0, "step_count", 5.0)]
    ingest(spark, one, dst, force=True, subject=42)
    assert stored(spark, dst) == [(42, "step_count", 5.0)]
    put(os.path.join(tmp, "two"), "alice_2024-01-15.xml", *days(STEPS, [5]))
    put(os.path.join(tmp, "two"), "bob_2024-01-15.xml", *days(STEPS, [6]))
    with pytest.raises(ValueError):
        ingest(spark, os.path.join(tmp, "two"), dst)


def test_streaming_available_now_ingests_once(spark, tmp, export_dir):
    from pulsegrid.streaming.ingest import ingest_available

    dst, ck = os.path.join(tmp, "stream_out"), os.path.join(tmp, "stream_ck")
    first = ingest_available(spark, export_dir, dst, ck)
    second = ingest_available(spark, export_dir, dst, ck)
    assert first["records_seen"] == 10 and first["workouts"] == 1
    assert second["records_seen"] == 0
    assert read_tables(spark, dst)[0].count() == 8
    put(export_dir, "subject=7_later.xml", *days(STEPS, [1, 2]))  # a re-export under a new name replaces
    assert ingest_available(spark, export_dir, dst, ck)["records_seen"] == 2
    assert stored(spark, dst) == [(7, "step_count", 1.0), (7, "step_count", 2.0)]


def test_weekly_run_end_to_end(spark, tmp):
    from pulsegrid.plans.analysis import run

    land = os.path.join(tmp, "land")
    os.makedirs(land)
    body = []
    for d in range(40):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        body.append(rec("HKQuantityTypeIdentifierRestingHeartRate", str(55 + (d % 5) + (30 if d == 35 else 0)),
                        f"{day} 07:00:00 -0600"))
        body.append(rec("HKQuantityTypeIdentifierStepCount", str(1000 * (d % 7)), f"{day} 12:00:00 -0600"))
        body.append(rec("HKQuantityTypeIdentifierHeartRateVariabilitySDNN", str(40 + d % 9), f"{day} 06:00:00 -0600"))
        body.append(rec("HKCategoryTypeIdentifierSleepAnalysis", str(d % 6), f"{day} 23:00:00 -0600",
                        end=f"{day + dt.timedelta(days=1)} 06:00:00 -0600"))
    with open(os.path.join(land, "subject=3.xml"), "w") as f:
        f.write(HEADER + "".join(body) + FOOTER)
    dst = os.path.join(tmp, "out")
    run(spark, land, dst, "2024-02-07")
    run(spark, land, dst, "2024-02-14", force_monthly=True)
    from pulsegrid.sources.reports import read_metric_log, read_report

    rep = os.path.join(dst, "reports")
    assert read_report(spark, rep, "overview", "2024-02-14").count() >= 3
    runs = spark.read.parquet(os.path.join(dst, "snapshots", "runs")).orderBy("report_date").collect()
    assert [(str(r.report_date), r.run_number) for r in runs] == [("2024-02-07", 1), ("2024-02-14", 2)]
    assert read_report(spark, rep, "anomalies", "2024-02-14").count() >= 0
    ctx = read_report(spark, rep, "context", "2024-02-14").first().text
    assert ctx.startswith("## Data Context  (date range: 2024-01-01 to 2024-02-09)")
    assert read_report(spark, rep, "monthly_totals", "2024-02-14").first().weeks_covered == 2
    assert read_report(spark, rep, "workouts_by_type", "2024-02-14").count() == 0  # without rows, still readable
    assert not [d for d in spark.sql("SHOW DATABASES").collect() if d[0].startswith("pulsegrid_run_")]
    log = read_metric_log(spark, rep)
    assert log.where("date = DATE'2024-02-14'").count() >= 1           # second run upserted its row
    # First run (a new page): only back-filled history -- the export runs to
    # 2024-02-09, so 2024-02-07 holds raw points with trend 'flat', never the
    # run's own report row.
    first = log.where("date = DATE'2024-02-07'").collect()
    assert first and {r.trend for r in first} == {"flat"}


def test_run_on_a_lone_export(spark, tmp):
    """The usual input: one export.xml, its path naming nobody; sleep stages by
    the opt-in codes, other windows and threshold."""
    from pulsegrid.plans.analysis import run
    from pulsegrid.sources.reports import read_report

    body = []
    for d in range(30):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=d)
        body.append(rec(HEART, str(60 + d % 5 + (40 if d == 25 else 0)), f"{day} 07:00:00 -0600"))
        for k, stage in enumerate(("AsleepCore", "AsleepDeep", "Awake", "AsleepREM")):
            body.append(rec("HKCategoryTypeIdentifierSleepAnalysis", f"HKCategoryValueSleepAnalysis{stage}",
                            f"{day} 2{k % 2}:00:00 -0600", end=f"{day} 2{k % 2}:{30 + k}:00 -0600"))
    export = put(os.path.join(tmp, "in"), "export.xml", *body)
    codes = {"HKCategoryValueSleepAnalysisAsleepCore": 3, "HKCategoryValueSleepAnalysisAsleepDeep": 4,
             "HKCategoryValueSleepAnalysisAwake": 2, "HKCategoryValueSleepAnalysisAsleepREM": 5}
    dst = os.path.join(tmp, "out")
    run(spark, export, dst, "2024-01-31", category_codes=codes, threshold=1.5, windows=(7, 14))
    rep = os.path.join(dst, "reports")
    assert {r.subject_id for r in read_report(spark, rep, "overview", "2024-01-31").collect()} == {0}
    assert read_report(spark, rep, "sleep_nightly", "2024-01-31").count() == 30
    assert read_report(spark, rep, "anomalies", "2024-01-31").count() >= 1


def test_reports_forget_subjects_that_left(spark, tmp):
    from pulsegrid.sources.reports import read_report, write_report

    two = spark.createDataFrame([(1, 1.0), (2, 2.0)], "subject_id long, value double")
    for df in (two, two.where("subject_id = 2"), two.limit(0)):
        write_report(df, tmp, "r", "2024-01-31", order_by=["subject_id"])
        assert read_report(spark, tmp, "r", "2024-01-31").count() == df.count()


def test_numbers_as_text(spark):
    from pulsegrid.functions.timeparse import parse_double

    texts = ["1", "-2.5", " 3. ", ".5", "+1e3", "1d", "2f", "3L", "", "nan", "1_0", "0x1", "1,5", None, "inf", "1e", "--1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(parse_double("x")).collect()]
    assert got == [1.0, -2.5, 3.0, 0.5, 1000.0, None, None, None, None, None, None, None, None, None, float("inf"), None, None]


def test_rounds_once(spark):
    from pulsegrid.functions.rounding import half_up

    xs = [2.6749996, 2.675, 2.6749999999999998, -2.675, 1.005]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(half_up("x", 2)).collect()]
    assert got == [2.67, 2.68, 2.68, -2.68, 1.01]


def test_cluster_without_shared_folder_stops():
    from pulsegrid.session import ensure_checkpoint_dir, is_local

    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
    assert is_local("local[4]") and is_local("local") and not is_local("local-cluster[2,1,1024]") and not is_local("spark://x")


def test_workout_date_by_presence(spark):
    from pulsegrid.operators.workout import workout_stats, workout_weekly

    df = spark.createDataFrame([(1, dt.date(2024, 1, 3), 30.0), (1, None, 10.0)], "subject_id long, date date, total_duration double")
    assert workout_stats(df).first().total_workouts == 1
    assert workout_weekly(df).first().total_duration_min == 30.0


def test_streaming_daily_with_watermark(spark, tmp, export_dir):
    from pulsegrid.streaming.ingest import daily_stream

    q = (daily_stream(spark, export_dir).writeStream.outputMode("update").format("memory")
         .queryName("daily_stream_test").option("checkpointLocation", os.path.join(tmp, "ck_daily"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.metric, r.value) for r in spark.sql("SELECT * FROM daily_stream_test").collect()}
    assert ("resting_heart_rate", 55.0) in got and ("step_count", 1200.0) in got


def test_quoted_gt_and_single_quotes(spark, tmp):
    d = os.path.join(tmp, "q")
    os.makedirs(d)
    body = (" <Record type='HKQuantityTypeIdentifierHeartRate' sourceName='Watch > Phone' unit=\"count/min\" "
            "creationDate=\"2024-01-15 08:30:00 -0600\" startDate=\"2024-01-15 08:30:00 -0600\" "
            "endDate=\"2024-01-15 08:30:00 -0600\" value=\"61\"/>\n")
    with open(os.path.join(d, "subject=5.xml"), "w") as f:
        f.write(HEADER + body + FOOTER)
    a = [tuple(r) for r in read_records(spark, d).collect()]
    assert [r[1:] for r in a] == by_row_tag(spark, d, "Record", RECORD_ATTRS) and a[0][2] == "Watch > Phone"


def test_plain_tags_are_cut_at_quotes_only(spark, tmp):
    plain = ['<Record type="a" value="it\'s 1" device="&lt;x, y:1&gt;" unit="u"/>', '<Record  type="a"\tvalue = "it\'s 1" unit=\'u\'/>',
             '<Record value="v" unit=""> " type="b" sourceName="c"\n</Record>', '<Record type="a" type="b" value="x type="/>',
             '<Record value="1 &amp; 2" type="a"/>', '<Record type="a" value="v>w"/>', '<Record/>', '<Records type="a"/>']
    path = os.path.join(tmp, "export.xml")
    with open(path, "w") as f:
        f.write("<HealthData>\n" + "\n".join(plain) + "\n</HealthData>")
    got = elements(scan(spark, path)).where("kind IS NOT NULL").orderBy("place").select("type", "value", "unit", "sourceName")
    assert [tuple(r) for r in got.collect()] == [
        ("a", "it's 1", "u", None), ("a", "it's 1", "u", None), (None, "v", "", None), ("a", "x type=", None, None),
        ("a", "1 & 2", None, None), ("a", "v>w", None, None), (None, None, None, None)]
    # A plain tag has nothing for the patterns to read.
    tags = scan(spark, path).select(F.col("value"), F.col("value").rlike(_PLAIN).alias("plain"))
    assert [r.plain for r in tags.where("value LIKE 'Record%'").collect()] == [True, False, True, False, False, False, False, False]
