"""Operator 5: exact round trip, random access, the seekable format."""

import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from pulsegrid.llm import warc

LONG = "<p>é long page</p>" * 20
PAGES = [
    (1, "http://a/", LONG), (2, None, LONG), (3, "http://a/", None), (4, "u\r\nX: y%0A", ""), (5, "http://b/", "short"),
    (6, "http://b/", "short"), (7, "http://c/", "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 30), (None, "http://n/", LONG), (None, "n", "only null" * 20),
    (8, "http://d/", "x" * 99), (9, "http://d/", "x" * 99), (10, "http://d/", "y" * 100), (11, "http://d/", "y" * 100),
    (12, "http://big/", "z" * 3_000_000), (13, "r", "repeat" * 50), (13, "r", "repeat" * 50),
]


def written(spark, tmp, rows=PAGES, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    return warc.write_bundles(df.repartition(2), f"file://{tmp}/warc", frame_bytes=2_000, **options)


def brute(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, u, h in rows:
        h = h or ""
        f = first.get(h)
        refers = f if f is not None and f != i else None
        out.append((i, u, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(map(str, out))


def test_round_trip(spark, tmp):
    got = warc.read_bundles(written(spark, tmp)).collect()
    assert sorted(str((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute(PAGES)
    texts = {h or "" for _, _, h in PAGES}
    assert {r.payload.decode() for r in got if r.record_type == "response"} == texts
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_random_access_by_index(spark, tmp):
    index = written(spark, tmp).collect()
    assert len(index) == len(PAGES) and len({r.record_id for r in index}) == len(PAGES)
    assert max(r.frame for r in index) > 0
    for r in index:
        headers, block = warc.read_record(r.bundle, r.frame, r.offset)
        assert headers["WARC-Record-ID"] == r.record_id and headers.get("X-Page-ID") == (None if r.page_id is None else str(r.page_id))
        if r.record_type == "response" and r.page_id:
            assert block.decode() == dict((i, h or "") for i, _, h in PAGES)[r.page_id]


def test_bundles_are_plain_zstandard_with_a_footer(spark, tmp):
    index = written(spark, tmp)
    for (path,) in index.select("bundle").distinct().collect():
        data = open(path.removeprefix("file://"), "rb").read()
        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
        assert whole.count(b"WARC-Record-ID: ") == index.where(F.col("bundle") == path).count()
        frames, descriptor, magic = struct.unpack("<IBI", data[-9:])
        assert magic == warc.SEEKABLE and struct.unpack("<I", data[-9 - 8 * frames - 8:-9 - 8 * frames - 4])[0] == warc.SKIPPABLE


def test_small_bundles_and_empty_table(spark, tmp):
    index = written(spark, tmp, bundle_bytes=1)
    assert index.agg({"frame": "max"}).first()[0] <= 1  # closed after the first frame that passes the limit
    assert sorted(r.page_id or 0 for r in warc.read_bundles(index).collect()) == sorted(i or 0 for i, _, _ in PAGES)
    assert warc.read_bundles(written(spark, tmp, [])).count() == 0


def test_revisits_name_the_record_they_refer_to(spark, tmp):
    index = written(spark, tmp, date="2025-06-07T08:09:10Z").collect()
    headers = [warc.read_record(r.bundle, r.frame, r.offset)[0] for r in index]
    by_id = {h["WARC-Record-ID"]: h for h in headers}
    named = 0
    for h in headers:
        assert h["WARC-Date"] == "2025-06-07T08:09:10Z"
        if h["WARC-Type"] == "revisit":
            assert h["WARC-Refers-To-Date"] == h["WARC-Date"]
            target = by_id[h["WARC-Refers-To"]]  # in another bundle, perhaps
            assert target["WARC-Type"] == "response" and target["X-Page-ID"] == h["X-Refers-To-Page-ID"]
            assert target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and target.get("WARC-Target-URI") == h["WARC-Refers-To-Target-URI"]
            named += 1
    assert named == sum("'revisit'" in r for r in brute(PAGES)) > 0


def test_a_task_for_each_bundle(spark, tmp):
    index = written(spark, tmp, bundle_bytes=1)
    n = index.select("bundle").distinct().count()
    plan = warc.read_bundles(index)
    assert n > 3 and plan.rdd.getNumPartitions() == n
    twice = index.union(index).withColumn("place", F.lit("clash"))
    assert warc.read_bundles(twice).count() == len(PAGES)


def test_folder_without_a_scheme(spark, tmp):
    place = warc.qualified(spark, f"{tmp}/a b")
    assert place == f"file://{tmp}/a b" and warc.qualified(spark, "s3://x/y") == "s3://x/y"
    assert warc.qualified(spark, f"file:{tmp}") == f"file://{tmp}"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(df, f"{tmp}/plain")).count() == len(PAGES)
