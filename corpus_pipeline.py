"""A training corpus from ``documents``: quality rules, exact dedup, near-dedup,
mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet under the shared checkpoint folder and
rereads it, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, fertility, mixing, near_dedup, packing
from pulsegrid.llm.common import column, ranked, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the base rules or a band reject go.  Null and
    empty texts have no words and go; repeated rows are judged alike; a null
    language is judged by its script; an empty table stays empty; other columns
    pass through, whatever their names."""
    out = _unused("fertility", docs)
    judged = fertility.quality(docs, out=out)
    return judged.where(F.col(out)["kept"]).select(*map(column, docs.columns))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the one with the smallest id stays, null ids
    last, ties by the other columns.  A null text is the empty one; an empty
    table stays empty; columns of any name pass through."""
    return exact_dedup.exact_dedup(docs)


#: Rows without an id of their own up to which their keys are broadcast.
BROADCAST_ROWS = 100_000


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each near-duplicate group stays, the one with
    the smallest id.  Rows whose id is null or repeats get a number of their own
    above all ids, so they are compared like all others and stay last.  Texts
    without words link with nothing and stay; an empty table stays empty; columns
    of any name pass through."""
    key = _unused("key", docs)
    keyed = docs.withColumn(key, F.col("doc_id"))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    shared = staged(ids.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")), "shared-ids")
    if not shared.isEmpty():
        rows = docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
        rows = rows.join(shared.withColumnRenamed("id", "other"), F.col("id").eqNullSafe(F.col("other")), "left_semi").distinct()
        placed = staged(ranked(rows, F.col("id").isNull(), F.col("id"), F.col("digest"), out="place"), "shared-rows")
        top = ids.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        own = placed.select("id", "digest", (F.col("place") + 1 + top).alias("own"))
        own = F.broadcast(own) if placed.count() <= BROADCAST_ROWS else own
        met = docs.join(own, docs["doc_id"].eqNullSafe(own["id"]) & F.md5(docs["text"]).eqNullSafe(own["digest"]), "left")
        keyed = met.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(own["own"], docs["doc_id"]).alias(key))
    gone = near_dedup.near_groups(keyed, id_col=key).where("NOT kept").select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*map(column, docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mix takes it.  Texts without
    words are never taken; a null source is one of its own; rows that repeat id,
    source and text share their draws; an empty table stays empty; columns of any
    name pass through."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of sequences, with their token ids.  A null text is
    empty and has the closing id only; repeated rows are pieces of their own; an
    empty table gives no sequence; other columns are ignored."""
    return packing.packed(docs)


def _unused(name: str, docs: DataFrame) -> str:
    """``name``, or one like it that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Tokenisers, sampling and greedy packing have no SQL; tests/llm holds the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
