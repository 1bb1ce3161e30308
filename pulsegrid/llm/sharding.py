"""Sharding by vector bin packing (operator 9).

What is placed are groups of equal texts.  A group is a vector (bytes, tokens,
rows), measured in shares of the totals and weighted by ``WEIGHTS``; a shard's
capacity is its equal share of each.  Groups are placed by falling size (their
largest share), each into the shard where the dot product of the group's vector with
the residual capacity is highest, among the shards that still hold it, or its bytes at
least, if there are any.

Greedy placing is sequential, so it runs in lots: groups are dealt to lots of
about ``LOT``, each lot fills its own bins in parallel, and the bins of all lots
are groups of the next level, until one lot is left; its bins are the shards.  A
group's shard follows from its bins, level by level.

A group lies in one shard.  Only one that is larger than a shard in some dimension
is cut, by a hash of the row, into a part per shard, which leaves all shards the same
room for the other groups; there are fewer than ``3 * shards`` such groups, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, pieces, ranked, staged, table

SHARDS = 16
LOT = 4096
DIMENSIONS = ("bytes", "tokens", "rows")
#: Of each dimension in the dot product; the law's own counts most.
WEIGHTS = (8.0, 1.0, 1.0)


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of ``vectors`` (items by dimensions, the law's first), in
    order of falling size, ties as they stand."""
    totals = vectors.sum(axis=0)
    weights = np.array(WEIGHTS)
    share = vectors / np.where(totals > 0, totals, 1.0)
    residual = np.full((bins, vectors.shape[1]), 1.0 / bins)
    out = np.zeros(len(vectors), dtype=np.int64)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        fits = (residual >= share[k] - 1e-12).all(axis=1)
        score = residual @ (weights * share[k])
        if not fits.any():
            fits = residual[:, 0] >= share[k, 0] - 1e-12
        if fits.any():
            score = np.where(fits, score, -np.inf)
        best = int(np.argmax(score))
        out[k] = best
        residual[best] -= share[k]
    return out


def _packer(bins: int, columns: list[str]):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", kind="stable")
        rows["bin"] = place(rows[list(DIMENSIONS)].to_numpy(dtype=float), bins)
        return rows[columns]

    return pack


def placed(items: DataFrame, bins: int, lot: int = LOT) -> DataFrame:
    """``items``: item (binary) and the DIMENSIONS, longs.  (item, shard)."""
    fields = "lot long, item binary, bytes long, tokens long, rows long"
    level, count, levels = items, items.count(), []
    while True:
        lots = pieces(count, lot)
        dealt = level.select(F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(lots)).alias("lot"), "item", *DIMENSIONS)
        names = [*dealt.columns, "bin"]
        done = staged(dealt.groupBy("lot").applyInPandas(_packer(bins, names), fields + ", bin long"), "bins")
        done = done.withColumn("up", F.unhex(F.md5(F.concat_ws(":", "lot", "bin"))))
        levels.append(done)
        if lots == 1:
            break
        level = done.groupBy(F.col("up").alias("item")).agg(*[F.sum(d).alias(d) for d in DIMENSIONS])
        count = lots * bins
    shard = levels[-1].select("item", F.col("bin").cast("int").alias("shard"))
    for below in reversed(levels[:-1]):
        shard = below.select("item", "up").join(shard.withColumnRenamed("item", "up"), "up").select("item", "shard")
    return shard


def shards_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
              lot: int = LOT) -> DataFrame:
    """One row per input row: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``,
    ``n_tokens`` (words), ``law`` (bytes), ``shard`` and ``slot`` in it, gapless
    from 0 in order of id; ``grown_shard`` is null under this law.

    Defined results: a null text has no bytes and is grouped with empty ones; a
    null id sorts last; rows that repeat an id are placed with their text like
    any other.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.unhex(F.md5(text)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"),
                                               F.count(F.lit(1)).alias("rows")), "shard-groups")
    totals = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    share = F.greatest(*[F.col(d) / max(1, totals[d]) for d in DIMENSIONS]) * shards
    # Bounded: each of these groups holds over 1 / shards of a total.
    large = staged(groups.where(share > 1).select("digest", F.lit(shards).cast("long").alias("parts")).coalesce(1), "large-groups")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")))
    item = F.unhex(F.md5(F.concat_ws(":", F.hex("digest"), part)))
    parted = rows.join(F.broadcast(large), "digest", "left").withColumn("item", item)
    whole = groups.join(F.broadcast(large), "digest", "left_anti") \
                  .select(F.unhex(F.md5(F.concat_ws(":", F.hex("digest"), F.lit(0)))).alias("item"), *DIMENSIONS)
    cut = parted.where("parts IS NOT NULL").groupBy("item").agg(
        F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    where = placed(staged(whole.union(cut), "shard-items"), shards, lot)
    found = parted.join(where, "item").select("id", "size", "text_crc32", "n_tokens", "shard")
    order = ranked(found, F.col("shard"), F.col("id").isNull(), F.col("id"), out="place")
    counts = {r["shard"]: r["n"] for r in order.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, at = [], 0
    for k in range(shards):
        first.append(at)
        at += counts.get(k, 0)
    slot = F.col("place") - F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return order.select(F.col("id").alias(id_col), "size", "text_crc32", "n_tokens", F.lit("bytes").alias("law"),
                        "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 under the law ``bytes``."""
    return shards_of(table(spark, sf_dir, "documents"))
