"""Health-export XML source (S1, S2): one parser for files of every size.

The text source cuts files at ``<``, which can't occur inside an attribute
value, so each row is one tag with the text after it, and a file of any size is
shared by many tasks.  One scan serves both elements.  Attributes are taken from
the tag's head by regular expressions; the five named entities and numeric
character references are decoded.  A plain tag, as exporters write nearly all of
them, is only cut at its quotes.

Comments.  An element between ``<!--`` and ``-->`` is no data.  Rows that open or
close a comment are kept with their place in the file, and elements between
them are dropped; exports hold few comments, if any.

The subject of an element is the ``subject=<id>`` of its file's path, else the
``subject`` parameter, else the default subject.  Nothing is guessed from other
digits in a name, and more than one file without an id is an error, since two
people would become one.

Bundles.  A population lands as files that hold the exports of many subjects, so
that their number follows the data.  A bundle has ``bundle=<name>`` and no subject in its path;
each of its elements names its subject in an attribute of its own
(``<Record subject="7" .../>``), an export without elements stands as
``<Export subject="7"/>``, and what names nobody is the default subject's.  All of a
subject's elements in one bundle are one export of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.model import DEFAULT_SUBJECT

# Attribute lists of the two elements, as exported.
RECORD_ATTRS = ["type", "sourceName", "unit", "value", "creationDate", "startDate", "endDate"]
WORKOUT_ATTRS = [
    "workoutActivityType", "duration", "durationUnit", "totalDistance", "totalDistanceUnit",
    "totalEnergyBurned", "totalEnergyBurnedUnit", "sourceName", "creationDate", "startDate", "endDate",
]
XML_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")]

ATTRS = list(dict.fromkeys(RECORD_ATTRS + WORKOUT_ATTRS))
READ = ["subject", *ATTRS]
SUBJECT = r"subject=(\d+)"
BUNDLE = r"(^|/)bundle=[^/]+"

# The attributes of a tag: everything up to the first '>' that is not inside a
# quoted value (a raw '>' is legal there).  Possessive, so it never backtracks.
_HEAD = r"""^(?:Record|Workout|Export)(\s(?:[^"'<>]++|"[^"]*+"|'[^']*+')*+)"""
_ATTRIBUTE = r"""[A-Za-z_][\w:.-]*+\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""
_SPACE = " \t\n\x0b\f\r"

# A tag of 'name="value"' with a space before each name and no reference, white
# space to replace, '<', '>' or '=' in a value: a text after every second quote, and
# ' name=' nowhere but at that attribute.  ``device`` isn't read and may hold references.
_PLAIN = r"""^(?:Record|Workout|Export)(?: (?:device="[^"<>=]*+"|[A-Za-z_][\w:.-]*+="[^"<>&=\n\r\t]*+"))++\s*+/?+>"""
_REFERENCE = r"^(#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[a-z]+);"


def subject_of(path: Column, subject: int | None = None) -> Column:
    tagged = F.regexp_extract(path, SUBJECT, 1)
    return F.when(path.contains("subject=") & (tagged != ""), tagged.cast("bigint")).otherwise(F.lit(DEFAULT_SUBJECT if subject is None else subject))


def is_bundle(path: Column) -> Column:
    return path.contains("bundle=") & path.rlike(BUNDLE) & ~(path.contains("subject=") & path.rlike(SUBJECT))


def _decoded(part: Column) -> Column:
    """Text that followed an ``&``, its reference decoded; an unknown one, or
    one to no character, stays as written."""
    ref = F.regexp_extract(part, _REFERENCE, 1)
    digits = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 6), 16, 10)).otherwise(F.substring(ref, 2, 7))
    code = F.when(ref.startswith("#"), digits.cast("int"))
    exists = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.when(exists, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for name, value in XML_ENTITIES:
        char = F.when(ref == name, F.lit(value)).otherwise(char)
    rest = F.substr(part, F.length(ref) + F.lit(2))
    return F.when(char.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), part))


def _unescaped(plain: Column) -> Column:
    """References decoded in one pass, so that a decoded ``&`` starts no other."""
    parts = F.split(plain, "&")
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), _decoded), ""))
    return F.when(plain.contains("&"), decoded).otherwise(plain)


def _attributes(tags: DataFrame) -> DataFrame:
    """``read``: the values of the attributes ``READ``.  Those of a plain tag stand
    in its ``parts`` after their names; from ``head`` come ``names`` and ``values`` of a tag's
    attributes as arrays side by side, in one pass over its 'name="value"' texts."""
    found = tags.withColumn("found", F.regexp_extract_all("head", F.lit(_ATTRIBUTE), F.lit(0))).drop("head")
    name = lambda a: F.rtrim(F.substring_index(a, "=", 1), F.lit(_SPACE))
    quoted = lambda a: F.ltrim(F.substr(a, F.instr(a, "=") + 1), F.lit(_SPACE))
    inside = lambda q: F.translate(F.substr(q, F.lit(2), F.length(q) - 2), "\n\r\t", "   ")  # noqa: E731  white space is a space each
    plain = found.withColumn("plain", F.transform(F.transform("found", quoted), inside))
    # What a lambda reads is asked for outside of it as well, so that it stays a column
    # and isn't computed again for every wanted name.
    plain = plain.select(*tags.drop("head").columns, F.slice("parts", F.lit(2), F.size("parts")).alias("after"),
                         F.transform("found", name).alias("names"), F.transform("plain", _unescaped).alias("values"))
    cut = F.transform(F.array(*[F.lit(f" {a}=") for a in READ]), lambda n: F.get("after", F.array_position("parts", n).cast("int") - 1))
    first = F.transform(F.array(*map(F.lit, READ)), lambda n: F.get("values", F.array_position("names", n).cast("int") - 1))
    there = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    # One array, not a column of expressions each: the JVM doesn't compile so long a method.
    return plain.select(*tags.drop("head", "parts").columns,
                        F.when(there("parts", "after"), cut).when(there("names", "values"), first).alias("read"))


def _attribute(name: str) -> Column:
    """The value of the first attribute ``name``, null without one."""
    return F.get("read", F.lit(READ.index(name)))


def _is_tag(value: Column, name: str) -> Column:
    return value.startswith(name) & F.substring(value, len(name) + 1, 1).isin(*_SPACE, "/", ">")


def elements(rows: DataFrame, subject: int | None = None, ordered: bool = True) -> DataFrame:
    """From ``rows`` of the text scan: subject_id, path, mtime, length, place,
    kind (Record, Workout, in a bundle also Export, or null), marker (open or close
    of a comment, file for a file's start, or null) and all attributes as text.
    Marks in a bundle are nobody's: their subject is null.  The rows of a stream
    aren't ``ordered``: their place in the file is unknown."""
    value, bundle, plain = F.col("value"), F.col("bundle"), F.col("plain")
    head = F.substring_index(value, ">", 1)  # of a plain tag
    kind = F.when(_is_tag(value, "Record"), "Record").when(_is_tag(value, "Workout"), "Workout") \
            .when(bundle & _is_tag(value, "Export"), "Export")
    ends = value.contains("-->")
    start = ~bundle & (F.col("block") == 0) & (F.length(F.trim(value)) <= 1)  # before the first tag, a byte order mark at most
    marker = F.when(value.startswith("!--") & ~ends, "open").when(ends & ~value.startswith("!--"), "close").when(start, "file")
    rows = rows.select("*", is_bundle(F.col("path")).alias("bundle"), value.rlike(_PLAIN).alias("plain"))
    tags = rows.select(subject_of(F.col("path"), subject).alias("subject_id"), "path", "mtime", "length",
                       F.struct("block", (F.monotonically_increasing_id() if ordered else F.lit(None).cast("bigint")).alias("row"))
                       .alias("place"),
                       "bundle", kind.alias("kind"), marker.alias("marker"), F.when(~plain, F.regexp_extract(value, _HEAD, 1)).alias("head"),
                       F.when(plain, F.split(F.substr(head, F.instr(head, " ")), '"')).alias("parts")) \
               .where(F.col("kind").isNotNull() | F.col("marker").isNotNull())
    own = F.coalesce(_attribute("subject").try_cast("bigint"), F.col("subject_id"))
    whose = F.when(~F.col("bundle"), F.col("subject_id")).when(F.col("kind").isNotNull(), own)
    return _attributes(tags).select(whose.alias("subject_id"), "path", "mtime", "length", "place", "kind", "marker",
                                    *[_attribute(a).alias(a) for a in ATTRS])


def scan(spark: SparkSession, path: str, stream: bool = False, since: str | None = None,
         files_per_batch: int | None = None) -> DataFrame:
    """The tags of the files under ``path``, for ``elements``; ``since`` leaves
    files last changed up to that second (session time zone) out of the listing,
    ``files_per_batch`` bounds a stream's micro-batches."""
    reader = (spark.readStream if stream else spark.read).format("text").option("lineSep", "<").option("recursiveFileLookup", "true")
    if since is not None:
        reader = reader.option("modifiedAfter", since)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if stream:  # by default a file over a week older than the newest one is passed over
        reader = reader.option("maxFileAge", "36500d")
    text = reader.load(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("length"),
                       F.col("_metadata.file_block_start").alias("block"))


def uncommented(parsed: DataFrame) -> DataFrame:
    """The elements of ``parsed`` (a written table of ``elements``) that are in
    no comment.  Only comment marks are sorted, per file."""
    marks = parsed.where("marker IN ('open', 'close')").select("path", "place", "marker")
    later = Window.partitionBy("path").orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    close = F.min(F.when(F.col("marker") == "close", F.col("place"))).over(later)
    spans = marks.select(F.col("path").alias("_path"), F.col("place").alias("_from"), close.alias("_to"), "marker") \
                 .where("marker = 'open'").drop("marker")
    data = parsed.where("kind IS NOT NULL")
    if spans.isEmpty():
        return data
    inside = (F.col("path") == F.col("_path")) & (F.col("place") > F.col("_from")) \
        & (F.col("_to").isNull() | (F.col("place") <= F.col("_to")))
    return data.join(spans, inside, "left_anti")


def exports_in(parsed: DataFrame, data: DataFrame) -> DataFrame:
    """The exports (subject_id, path, mtime, length) that a written table of
    ``elements`` has something of; ``data`` is it ``uncommented``."""
    key = ["subject_id", "path", "mtime", "length"]
    marked = parsed.where("kind IS NULL AND subject_id IS NOT NULL").select(key)
    return marked.unionByName(data.select(key)).distinct()


def records_of(data: DataFrame) -> DataFrame:
    """``<Record>`` elements, 7 text attributes; children are ignored."""
    return data.where("kind = 'Record'").select("subject_id", *RECORD_ATTRS)


def workouts_of(data: DataFrame) -> DataFrame:
    """``<Workout>`` elements, 11 text attributes."""
    return data.where("kind = 'Workout'").select("subject_id", *WORKOUT_ATTRS)


def exports(spark: SparkSession, path: str, subject: int | None = None) -> DataFrame:
    """The files under ``path`` (subject_id, path, mtime, length), by the scan's own
    listing, contents unread.  The subject of a bundle is null.  Other files that name
    no subject must be one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"),
                         F.col("_metadata.file_size").alias("length"))
    whose = F.when(~is_bundle(F.col("path")), subject_of(F.col("path"), subject))
    files = files.select(whose.alias("subject_id"), "path", "mtime", "length")
    unnamed = files.where(~F.col("path").rlike(SUBJECT) & F.col("subject_id").isNotNull()).limit(2).count()
    if unnamed > 1:
        raise ValueError(f"several exports under {path} name no subject; put each under subject=<id>")
    return files


#: Files (path, time and length of each: some 300 bytes) whose list is broadcast to
#: the scan's tasks; a longer list meets the elements in a join by path.
BROADCAST_FILES = 50_000


def parse(spark: SparkSession, path: str, files: DataFrame, count: int, since: str | None = None,
          subject: int | None = None) -> DataFrame:
    """``elements`` of the ``count`` files under ``path`` that ``files`` lists, in
    one scan, no path passing through this process.  ``since``: a
    second before all of them, so that what was ingested before is not even opened."""
    rows = scan(spark, path, since=since)
    chosen, key = files.select("path", "mtime", "length"), ["path", "mtime", "length"]
    if count <= BROADCAST_FILES:
        return elements(rows.join(F.broadcast(chosen), key, "left_semi"), subject)
    return elements(rows, subject).join(chosen, key, "left_semi")


def read_records(spark: SparkSession, path: str, subject: int | None = None) -> DataFrame:
    """S1 over all files under ``path``, read and written once (see ``uncommented``)."""
    return records_of(_all(spark, path, subject))


def read_workouts(spark: SparkSession, path: str, subject: int | None = None) -> DataFrame:
    """S2 over all files under ``path``."""
    return workouts_of(_all(spark, path, subject))


def _all(spark: SparkSession, path: str, subject: int | None) -> DataFrame:
    from pulsegrid.session import materialize

    exports(spark, path, subject)
    return uncommented(materialize(elements(scan(spark, path), subject), "elements"))
