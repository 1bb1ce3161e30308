"""Bundles: files with the exports of many subjects."""

import os

from pyspark.sql import functions as F

from test_ingest import HEART, STEPS, days, put, stored

AT = "2024-01-15 08:30:00 -0600"


def of(subject, *records):
    """Elements that name their subject."""
    return [r.replace("<Record ", f'<Record subject="{subject}" ') for r in records]


def test_exports_of_many_subjects_are_few_files(spark, tmp):
    from pulsegrid.plans.catalog import write_exports
    from pulsegrid.sources.xml import exports, read_records, read_workouts

    raw = spark.range(3000).select(
        (F.col("id") % 300).alias("subject_id"), F.when(F.col("id") % 5 == 0, "Purchase").otherwise("Click").alias("type"),
        F.lit('a & "b"').alias("sourceName"), F.lit("x").alias("unit"), F.col("id").cast("string").alias("value"),
        F.lit(AT).alias("creationDate"), F.lit(AT).alias("startDate"))
    joined = raw.join(spark.range(300).withColumnRenamed("id", "subject_id"), "subject_id", "left_semi")
    for name, rows in (("plain", raw), ("joined", joined)):
        folder = os.path.join(tmp, name)
        write_exports(rows, folder)
        assert exports(spark, folder).count() <= 8
        got = read_records(spark, folder).select("subject_id", "value", "sourceName").collect()
        assert sorted((r[0], int(r[1]), r[2]) for r in got) == sorted((k % 300, k, 'a & "b"') for k in range(3000))
        assert read_workouts(spark, folder).count() == 600
        files = spark.read.text(folder, recursiveFileLookup=True).select(
            F.regexp_extract("value", 'subject="([0-9]+)"', 1).alias("s"), F.col("_metadata.file_path").alias("file"))
        assert files.groupBy("s").agg(F.count_distinct("file").alias("n")).where("n > 1").count() == 0


def test_readings_of_nobody_keep_their_file(spark, tmp):
    from pulsegrid.plans.catalog import write_exports
    from pulsegrid.sources.xml import read_records

    raw = spark.createDataFrame([(None, "5"), (7, "6")], "subject_id long, value string").select(
        "subject_id", F.lit("Click").alias("type"), F.lit("s").alias("sourceName"), F.lit("x").alias("unit"), "value",
        F.lit(AT).alias("creationDate"), F.lit(AT).alias("startDate"))
    write_exports(raw, tmp)
    assert sorted((r.subject_id, r.value) for r in read_records(spark, tmp).collect()) == [(0, "5"), (7, "6")]


def test_newest_export_counts_whatever_its_file(spark, tmp):
    from pulsegrid.plans.ingest import ingest

    src, dst = os.path.join(tmp, "landing"), os.path.join(tmp, "tables")
    put(src, "bundle=a/1.xml", *of(1, *days(STEPS, [1])), *of(2, *days(STEPS, [2, 3])), *of(3, *days(STEPS, [4])),
        "<!-- ", *of(4, *days(STEPS, [9])), " -->", mtime=1_700_000_000)
    put(src, "subject=2.xml", *days(HEART, [60]), mtime=1_600_000_000)  # older than the bundle
    assert ingest(spark, src, dst)["mode"] == "full"
    first = [(1, "step_count", 1.0), (2, "step_count", 2.0), (2, "step_count", 3.0), (3, "step_count", 4.0)]
    assert stored(spark, dst) == first
    assert ingest(spark, src, dst)["mode"] == "unchanged"
    put(src, "bundle=b/1.xml", *of(1, *days(HEART, [70])), ' <Export subject="3"/>\n', "<!-- ", *of(2, *days(STEPS, [5])), " -->",
        mtime=1_700_000_100)
    put(src, "bundle=late/1.xml", *of(1, *days(STEPS, [8])), *of(6, *days(STEPS, [6])), mtime=1_650_000_000)
    put(src, "subject=5.xml", *days(STEPS, [5]), mtime=1_700_000_000)
    assert ingest(spark, src, dst)["mode"] == "update"
    want = [(1, "heart_rate", 70.0), (2, "step_count", 2.0), (2, "step_count", 3.0), (5, "step_count", 5.0), (6, "step_count", 6.0)]
    assert stored(spark, dst) == want
    assert ingest(spark, src, dst)["mode"] == "unchanged"  # also with bundles that nothing is held of
    assert ingest(spark, src, dst, force=True)["mode"] == "full" and stored(spark, dst) == want


def test_bundles_as_a_stream(spark, tmp):
    from pulsegrid.streaming.ingest import ingest_available

    src, dst, ck = (os.path.join(tmp, n) for n in ("landing", "tables", "ck"))
    put(src, "bundle=a/1.xml", *of(1, *days(STEPS, [1])), *of(2, *days(STEPS, [2])), mtime=1_700_000_000)
    assert ingest_available(spark, src, dst, ck, buckets=2)["records_seen"] == 2
    put(src, "bundle=a/2.xml", *of(2, *days(STEPS, [3])), mtime=1_700_000_100)
    put(src, "bundle=a/3.xml", *of(1, *days(STEPS, [9])), *of(3, *days(STEPS, [4])), mtime=1_600_000_000)
    ingest_available(spark, src, dst, ck, buckets=2)
    assert stored(spark, dst) == [(1, "step_count", 1.0), (2, "step_count", 3.0), (3, "step_count", 4.0)]


def test_attributes_as_written(spark, tmp):
    from pulsegrid.sources.xml import read_records

    tag = " <Record type = 'a=b \"c\"'\n\tsourceName\t=\n\"x\ty &lt; 'z'\" value=\"\" unit=\"= u =\" value=\"2\" subject=\"9\"/>\n"
    put(tmp, "subject=5.xml", tag)
    r = read_records(spark, tmp).first()
    assert (r.subject_id, r.type, r.sourceName, r.value, r.unit, r.endDate) == (5, 'a=b "c"', "x y < 'z'", "", "= u =", None)
