"""Exact dedup by skew-safe combining (operator 10).

Texts are equal when identical after each run of ASCII white space became one
space.  The method, in DataFrame operations only:

1. *local*: every task first combines the equal texts it has read itself (the
   map side of the first aggregation);
2. *salted*: the tasks' winners meet in ``salts`` groups per digest, the salt
   being the number of the task that read them, so that a digest that holds a
   third of all rows is spread;
3. *global*: one winner per salt is left, and those meet by digest.

The whole normalised text is a grouping key at each of the three stages, next
to its SHA-256, so texts are compared in full and two texts are never merged
for having the same digest.  What is combined is an aggregate (smallest id,
count), never a list, so no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import staged, table

SPACE_RUN = r"[\x20\x09-\x0D]+"
SALTS = 16


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _combined(rows: DataFrame, *aggregates: Column, merge: list[Column], salts: int) -> DataFrame:
    """``rows``: _sha, _norm and values.  Local and salted stage with
    ``aggregates``, global stage with ``merge``."""
    salted = (rows.withColumn("_salt", F.spark_partition_id() % salts)
              .groupBy("_sha", "_norm", "_salt").agg(*aggregates))
    return salted.groupBy("_sha", "_norm").agg(*merge)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: the id, ``keep_id`` (smallest id of its group),
    ``group_size``, ``kept`` and ``text_sha256`` of the normalised text.

    Defined results: a null text is empty and so equal to an empty or all-blank
    one only if that normalises to the same text (blank texts become one space,
    the empty text stays empty).  Null ids sort last: a group whose ids are all
    null has a null ``keep_id``.  Of rows that repeat both id and text exactly
    one is kept.  Other columns of ``df`` are ignored.  An empty table gives no
    rows.
    """
    rows = df.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm")) \
             .withColumn("_sha", _digest(F.col("_norm")))
    key = [F.col("_sha"), F.xxhash64("_norm").alias("_mix"), F.length("_norm").alias("_len")]
    classes = _combined(rows, F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_n"),
                        merge=[F.min("_min").alias("_min"), F.sum("_n").alias("_n")], salts=salts)
    # Rows find their winner by digest, a second hash and the length.  Should two
    # different texts ever share all three, the job stops instead of merging them.
    winners = (classes.select(*key, "_min", "_n").groupBy("_sha", "_mix", "_len")
               .agg(F.min("_min").alias("keep_id"), F.sum("_n").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
               .withColumn("group_size", F.when(F.col("_texts") == 1, F.col("group_size"))
                           .otherwise(F.raise_error(F.lit("two texts share their digests")).cast("long")))
               .drop("_texts"))
    winners = staged(winners, "exact-winners")
    # Rows that repeat id and text are one row with a count until the end, so
    # that exactly one copy can be marked without an order among equals.
    copies = rows.select("_id", *key).groupBy("_id", "_sha", "_mix", "_len").agg(F.count(F.lit(1)).alias("_copies"))
    out = copies.join(winners, ["_sha", "_mix", "_len"]) \
                .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with all columns of ``df``: of equal texts the row
    with the smallest id (null ids last; equal ids: the smallest in the other
    columns).  Same three stages; the row itself is what is combined."""
    others = [c for c in df.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).isNull().alias("_null"), F.col(id_col).alias("_id"),
                   *[F.col(c).alias(f"_c{k}") for k, c in enumerate(others)], F.col(text_col).alias("_text"))
    rows = df.select(normalised(F.col(text_col)).alias("_norm"), row.alias("_row")) \
             .withColumn("_sha", _digest(F.col("_norm")))
    kept = _combined(rows, F.min("_row").alias("_row"), merge=[F.min("_row").alias("_row")], salts=salts)
    back = {id_col: "_id", text_col: "_text"} | {c: f"_c{k}" for k, c in enumerate(others)}
    return kept.select(*[F.col(f"_row.{back[c]}").alias(c) for c in df.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all ``documents``, one row per document."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
