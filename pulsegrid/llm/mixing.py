"""Mixing sources to target weights by the cube method (operator 1).

Every source gets a target number of words.  A document of a source is then
taken ``target / source size`` times: the whole part of that for certain, the
rest with that inclusion probability.  Which documents get the extra copy is
drawn by cube-method balanced sampling, so that the drawn words and the drawn
documents of the source both come out as expected:

* *flight*: probabilities are moved along the null space of the two constraints
  (words, documents), up or down at random without bias, until one of them is 0
  or 1 and its document decided.  Heavy documents move first, each against all
  that are undecided; the others move by threes.  Words and documents of the
  block are kept at each step;
* blocks: a source of any size flies in blocks of about ``BLOCK`` documents, in
  parallel.  Each leaves at most two documents undecided, which fly again in
  blocks with those of other blocks, level by level, until one block is left;
* *landing*: the last two or fewer documents of a source give up the document
  total first, then the word total.

All draws are seeded by source, level and block, and documents are ordered by a
digest of their row, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, column, ranked, row_key, staged, table

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST = 3.0
#: The targets' sum as a share of all sizes.
SHARE = 1.0
BLOCK = 2048
#: Heavy: over so many times the mean size of the block.
HEAVY = 0.5
SEED = 7
NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, n) with the source's place and target.
    The excess of capped sources is shared again by weight until none is above
    its cap; only sums over all sources reach the driver."""
    placed = ranked(sizes, F.col("source").isNull(), F.col("source"), out="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = staged(placed.withColumn("weight", weight), "sources")
    cap = most * F.col("source_size")
    level, total = 0.0, (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        capped = F.col("weight") * level > cap
        held, free = placed.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
                                F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    shared = F.col("weight") * level
    return placed.withColumn("target", F.when(shared > cap, cap).otherwise(shared))


def _step(p: np.ndarray, at: np.ndarray, u: np.ndarray, coin: float) -> None:
    """Move the probabilities of ``at`` along ``u`` or against it, as far as one
    of them gets to 0 or 1, each way with the odds that keep all expectations."""
    moved = np.abs(u) > 1e-15
    at, u = at[moved], u[moved]
    up = np.min(np.where(u > 0, 1 - p[at], -p[at]) / u)
    down = np.min(np.where(u > 0, p[at], p[at] - 1) / u)
    value = p[at] + (up if coin * (up + down) < down else -down) * u
    p[at] = np.where(value < NEAR, 0.0, np.where(value > 1 - NEAR, 1.0, value))


def _ballast(size: float, others: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Moves of the other documents, each in proportion to its ``weight``, that
    make up for one document of ``size`` in words and in documents (in words
    alone where all others have one size)."""
    n, words, squares = weight.sum(), (weight * others).sum(), (weight * others ** 2).sum()
    det = n * squares - words ** 2
    if det <= 1e-9 * n * squares:
        return -weight * size / words
    return weight * ((size * words - squares) / det + (words - size * n) / det * others)


def flight(probability: list[float], size: list[int], coins, land: bool) -> list[float]:
    """Cube flight over one block of documents with words, in the given order;
    ``land`` decides all.  First the documents of over ``HEAVY`` mean sizes, the
    heaviest first, each against all that are undecided, so that what is left for
    the landing is small; then the others by threes."""
    p, s = np.array(probability, dtype=float), np.array(size, dtype=float)
    unit = s / s.mean() if len(s) else s
    for i in np.argsort(-s, kind="stable"):
        if unit[i] <= HEAVY:
            break
        while 0 < p[i] < 1:
            others = np.flatnonzero((p > 0) & (p < 1))
            others = others[others != i]
            if len(others) < 3:
                break
            u = _ballast(unit[i], unit[others], p[others] * (1 - p[others]))
            _step(p, np.append(others, i), np.append(u, 1.0), coins())
    open_: list[int] = []
    for i in np.flatnonzero((p > 0) & (p < 1)):
        open_.append(i)
        while len(open_) == 3:
            a, b, c = unit[open_]
            u = np.array([b - c, c - a, a - b])
            _step(p, np.array(open_), u if u.any() else np.array([1.0, -1.0, 0.0]), coins())
            open_ = [k for k in open_ if 0 < p[k] < 1]
    if land:
        while len(open_) == 2:
            a, b = unit[open_]
            _step(p, np.array(open_), np.array([b, -a]), coins())
            open_ = [k for k in open_ if 0 < p[k] < 1]
        for k in open_:
            p[k] = 1.0 if coins() < p[k] else 0.0
    return p.tolist()


def _flier(seed: int, level: int, land: bool, columns: list[str]):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        coins = np.random.default_rng([seed, level, int(key[0]), int(key[1])]).random
        rows["chance"] = flight(rows["chance"].tolist(), rows["size"].tolist(), coins, land)
        return rows[columns]

    return fly


def draw(units: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``units``: place, n (documents of the source), key, size, chance and other
    columns.  The same rows with ``drawn`` 0 or 1 in place of ``chance``."""
    decided = units.where("chance = 0 OR chance = 1 OR size = 0").withColumn("chance", F.when(F.col("size") > 0, F.col("chance")).otherwise(0.0))
    open_ = units.where("chance > 0 AND chance < 1 AND size > 0").withColumn("blocks", F.ceil(F.col("n") / block))
    most = units.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        last = most <= block
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        flown = staged(dealt.groupBy("place", "block").applyInPandas(_flier(seed, level, last, dealt.columns), dealt.schema), "flight").drop("block")
        decided = decided.unionByName(flown.where("chance = 0 OR chance = 1").drop("blocks"))
        if last:
            return decided.withColumnRenamed("chance", "drawn")
        # At most two documents a block are left.
        most = 2 * -(-most // block)
        open_ = flown.where("chance > 0 AND chance < 1").withColumn("blocks", F.ceil(2 * F.col("blocks") / block))
        level += 1


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target,
    ``key`` (a digest of the row's id, source and text) and ``times`` taken.

    Defined results: a null source is a source of its own, last in order; a null
    text has size 0, and rows of size 0 are never taken; rows with equal id,
    source and text are told apart only by count; an empty table, or one without
    words, takes nothing.  Other columns are ignored.
    """
    # As text: pandas would turn a long column with nulls into floats.
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"),
                     F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                     row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"))
    rows = staged(rows, "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    plan = staged(targets(staged(sizes, "source-sizes"), weights, share, most).coalesce(1), "targets")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = rows.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))) \
                .withColumn("factor", factor).withColumn("whole", F.floor("factor")) \
                .withColumn("chance", F.col("factor") - F.col("whole")) \
                .withColumn("chance", F.when(F.col("chance") < NEAR, 0.0).when(F.col("chance") > 1 - NEAR, 1.0).otherwise(F.col("chance"))) \
                .select("id", "source", "size", "source_size", "target", "key", "place", "n", "whole", "chance")
    return draw(units).select(
        F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "key",
        F.when(F.col("size") > 0, F.col("whole") + F.col("drawn")).otherwise(0).cast("long").alias("times"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, each as often as it is taken.

    Rows with equal id, source and text share what was drawn for them; where that
    is no multiple of their number, the first ones by a hash of all their columns
    get one more.  Nulls, empty texts and tables as in ``mix``; all columns pass
    through untouched.
    """
    taken = mix(df, id_col, text_col, source_col, **options).groupBy("key") \
        .agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("equal")).where("times > 0")
    taken = staged(taken, "taken")
    # The caller's columns travel in one struct, so that none meets a name of this function.
    row = F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(df.columns)])
    own = df.select(row.alias("row"), row_key(column(id_col), column(source_col), column(text_col)).alias("key"))
    out = own.join(taken.where("equal = 1"), "key").select("row", "times")
    shared = taken.where("equal > 1")
    if not shared.isEmpty():
        # Only these rows are numbered, by range and not by key, so that equal
        # rows in any number are spread.
        places = ranked(own.join(shared, "key"), F.col("key"), F.xxhash64("row"), out="place")
        first = staged(places.groupBy("key").agg(F.min("place").alias("first")), "first-places")
        more = F.when(F.col("place") - F.col("first") < F.col("times") % F.col("equal"), 1).otherwise(0)
        out = out.unionByName(places.join(first, "key").select("row", (F.floor(F.col("times") / F.col("equal")) + more).alias("times")))
    copies = out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long"))))
    return copies.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(df.columns)])


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of all ``documents`` is taken into the mix, in words."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
