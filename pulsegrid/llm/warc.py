"""WARC archives in seekable Zstandard bundles (operator 5).

A bundle is one file: independent Zstandard frames, each of about ``FRAME_BYTES``
of records, then a seek table in a skippable frame (the public seekable format:
per frame its compressed and decompressed size, a footer with the number of
frames and a magic number).  Any Zstandard reader reads the bundle from start to
end as one WARC file; a reader with the seek table opens one frame.

``write_bundles`` also returns the index: per record its bundle, frame and
offset in the frame.  ``read_record`` gets a record by those without reading
anything else of the bundle.

Equal payloads (by SHA-256) of at least ``LEAST_BYTES`` are written once; the
others are revisit records that refer to it.

Each task writes its own bundles under a name no other attempt uses, and the
index, committed by Spark, names the files of the attempts that count; what a
lost attempt left is never read.  The folder must be one that all executors and
the driver share.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import ranked, staged, table
from pulsegrid.session import ensure_checkpoint_dir

FRAME_BYTES = 1_000_000
BUNDLE_BYTES = 64_000_000
LEAST_BYTES = 100
#: The capture date of pages that have none of their own.
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "bundle string, frame long, offset long, length long, record_id string, page_id long, record_type string"
RECORD = "bundle string, frame long, offset long, record_id string, page_id long, url string, record_type string, " \
         "payload binary, payload_bytes long, payload_digest string, refers_to long"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a URI.  One without a scheme lies on Spark's default file
    system; which that is shows a file that Spark itself has just written there."""
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", folder):
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/_place")
        place = spark.read.parquet(f"{folder}/_place").select(F.col("_metadata.file_path")).first()[0]
        folder = unquote(place[:place.index("/_place/")])
    return folder if "://" in folder else re.sub(r"^(\w+):/*", r"\1:///", folder)


def _line(value: str) -> str:
    """A header value on one line; percent signs keep it reversible."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _value(line: str) -> str:
    return line.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_id_of(page_id: int | None, digest: str) -> str:
    """The id of a response that revisits refer to.  It follows from what is
    recorded, so that other tasks can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(record_id: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                 refers_uri: str | None = None, refers_id: str | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response, or a revisit without block."""
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}",
                 f"WARC-Refers-To-Date: {date}"]
        if refers_id is not None:
            head.append(f"WARC-Refers-To: {refers_id}")
        if refers_uri is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_line(refers_uri)}")
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Writer of one bundle file."""

    def __init__(self, path: str, frame_bytes: int):
        import zstandard

        self.path, self.frame_bytes = path, frame_bytes
        system, name = _filesystem(path)
        self.out, self.compressor = system.open_output_stream(name, compression=None), zstandard.ZstdCompressor(level=3)
        self.buffer, self.sizes, self.written = io.BytesIO(), [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        if self.buffer.tell() and self.buffer.tell() + len(record) > self.frame_bytes:
            self._end_frame()
        at = len(self.sizes), self.buffer.tell()
        self.buffer.write(record)
        return at

    def _end_frame(self) -> None:
        whole = self.buffer.getvalue()
        frame = self.compressor.compress(whole)
        self.out.write(frame)
        self.sizes.append((len(frame), len(whole)))
        self.written += len(frame)
        self.buffer = io.BytesIO()

    def close(self) -> None:
        if self.buffer.tell():
            self._end_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, size) of each frame, read from the footer."""
    end = file.size()
    file.seek(end - 9)
    count, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    each = 12 if descriptor & 0x80 else 8
    file.seek(end - 9 - count * each)
    raw, out, at = file.read(count * each), [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", raw, k * each)
        out.append((at, packed, size))
        at += packed
    return out


def _frame(file, place: int, packed: int, size: int) -> bytes:
    import zstandard

    file.seek(place)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)


def parse(frame: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one starts."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record at this offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    return headers, frame[end + 4:end + 4 + size], end + 8 + size


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: reads the seek table and one frame."""
    system, name = _filesystem(bundle)
    with system.open_input_file(name) as file:
        headers, block, _ = parse(_frame(file, *seek_table(file)[frame]), offset)
    return headers, block


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, ``refers_to`` (null: response), the
    response's url and ``alone``: whether the one row of the response (of a
    response: itself) is the only one with its page_id, so that it can be named."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")) \
                .withColumn("digest", F.unhex(F.sha2("html", 256))) \
                .withColumn("long", F.octet_length("html") >= least_bytes)
    by_page = rows.where("long").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url"))
    first = staged(by_page.groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n", "url"))).alias("r"), F.sum("n").alias("n"))
        .where("n > 1").select("digest", F.col("r.page_id").alias("first"), F.col("r.url").alias("first_url"),
                               (F.col("r.n") == 1).alias("alone")), "first-pages")
    met = rows.join(first, "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    refers = F.when(F.col("long") & ~own, F.col("first"))
    return met.select("page_id", "url", F.col("html").cast("binary").alias("payload"), F.lower(F.hex("digest")).alias("digest"),
                      refers.alias("refers_to"), F.when(refers.isNotNull(), F.col("first_url")).alias("refers_uri"),
                      (F.col("long") & F.coalesce("alone", F.lit(False)) & (own | refers.isNotNull())).alias("alone"))


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
                  least_bytes: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html), captured at ``date``, under
    ``folder``; the index.

    Defined results: a null html is an empty payload.  Rows that repeat the
    smallest page_id of equal payloads are all responses; where all its page_ids
    are null, so are all rows of a payload.  Null page_ids and urls stay null.
    Other columns are ignored; an empty table writes no file.
    """
    fields = T.StructType.fromDDL(INDEX)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for row in zip(*(c for c in batch.columns)):
                page_id, url, payload, digest, refers_to, refers_uri, alone = (x.as_py() for x in row)
                if bundle is None:
                    bundle = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                    count = 0
                if alone and refers_to is None:
                    record_id = record_id_of(page_id, digest)
                else:
                    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{bundle.path}#{count}')}>"
                count += 1
                refers_id = record_id_of(refers_to, digest) if alone and refers_to is not None else None
                record = record_bytes(record_id, page_id, url, payload, digest, refers_to, refers_uri, refers_id, date)
                frame, offset = bundle.add(record)
                rows.append((bundle.path, frame, offset, len(record), record_id, page_id, "response" if refers_to is None else "revisit"))
                if bundle.written > bundle_bytes:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=fields.names) if rows else empty
        if bundle is not None:
            bundle.close()

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(fields)]
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=fields.names)
    folder = qualified(pages.sparkSession, folder)
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)
    # Staged at once: the files are written once, and the index names those that count.
    return staged(with_types(pages, least_bytes).mapInArrow(written, fields), "warc-index")


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, columns RECORD.  Of a
    response, length and digest are those of the payload read; a revisit has
    those of the payload it refers to.  Bundles are dealt one by one, so that a
    task reads about one, however short their list is.  Defined results: an index
    without rows gives none; rows of the index that repeat a bundle count once;
    a null bundle is passed over; other columns of the index are ignored; a bundle
    that is missing or has no seek table stops the job."""
    fields = T.StructType.fromDDL(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = [f.type for f in to_arrow_schema(fields)]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _filesystem(path)
                with system.open_input_file(name) as file:
                    for number, place in enumerate(seek_table(file)):
                        frame, at, rows = _frame(file, *place), 0, []
                        while at < len(frame):
                            start = at
                            headers, block, at = parse(frame, at)
                            response = headers["WARC-Type"] == "response"
                            page, url, refers = (headers.get(h) for h in ("X-Page-ID", "WARC-Target-URI", "X-Refers-To-Page-ID"))
                            rows.append((path, number, start, headers["WARC-Record-ID"], page and int(page), url and _value(url),
                                         headers["WARC-Type"], block if with_payload and response else None,
                                         len(block) if response else int(headers["X-Payload-Length"]),
                                         hashlib.sha256(block).hexdigest() if response else headers["WARC-Payload-Digest"].split(":")[1],
                                         refers and int(refers)))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=fields.names)

    bundles = staged(index.where("bundle IS NOT NULL").select("bundle").distinct(), "bundles")
    n = max(1, bundles.count())
    # Places from 0 on (one short row per bundle), each a partition of its own.
    placed = ranked(bundles, F.col("bundle"), out="place")
    return placed.repartitionByRange(n, "place").select("bundle").mapInArrow(read, fields)


def op5_seekable_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all ``pages``, written and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    index = write_bundles(table(spark, sf_dir, "pages"), folder)
    return read_bundles(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
