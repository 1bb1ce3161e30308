"""Hard-negative mining by segment summaries (operator 11).

For each anchor, the rows of its own label with the highest inner products are
its positives; for each positive, the best rows of other labels whose score lies
in a band below the positive's are its hard negatives.

The method: a vector is cut into equal segments, and each segment is stored as
its mean and its deviation (root of the summed squared differences from the
mean).  Over a segment of L components the inner product of two vectors lies
within L times the product of the means, plus or minus the product of the
deviations.  The sums of these bounds over 1 segment, then 2, 4 and 8 (deviations
of halves give those of the whole) narrow the score; what the bounds can't
exclude goes to the next level, and what is left after the last is scored exactly.
Positives must reach the k-th best score that a task has seen; negatives the band of
a positive, or the k-th best inside it.

Anchors are a stated set of queries.  They are taken in chunks of at most
``CHUNK`` rows, whose packed vectors (bounded by that parameter) are broadcast;
each chunk meets all rows, packed in blocks of ``BLOCK`` rows, where these lie:
no vector is shuffled and no pair is written.  A task returns at most k rows per anchor.
Every chunk's results are written before the next, so a lost executor costs tasks only.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import pieces, staged, table
from pulsegrid.session import ensure_checkpoint_dir

POSITIVES = 5
NEGATIVES = 3
#: A negative's score, in hundredths of the positive's.
BAND = (50, 95)
#: Anchors per broadcast chunk, and of these at once against a block.
CHUNK = 8192
TILE = 512
BLOCK = 2048
#: Segments at each level; vectors are padded with zeros to a multiple of the last.
LEVELS = (1, 2, 4, 8)
#: Share of a tile's pairs up to which the next level works on single pairs.
SPARSE = 0.05
EXACT = 2.0 ** 53

PACKED = "n long, dims int, rids binary, ids binary, unnamed binary, labels binary, vectors binary, means binary, deviations binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Rows:
    """Rows of vectors with the summaries of their segments at every level."""

    def __init__(self, rids, ids, unnamed, labels, vectors, means=None, deviations=None):
        self.rids, self.ids, self.unnamed, self.labels, self.vectors = rids, ids, unnamed, labels, vectors
        n, finest = len(vectors), LEVELS[-1]
        if means is None:
            parts = vectors.reshape(n, finest, -1)
            means = parts.mean(axis=2) if parts.shape[2] else np.zeros((n, finest))
            deviations = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))
        size = vectors.shape[1] // finest
        #: Level -> (length of a segment, means, deviations).
        self.summary = {finest: (size, means, deviations)}
        for level in LEVELS[-2::-1]:
            left, right = means[:, 0::2], means[:, 1::2]
            deviations = np.sqrt(deviations[:, 0::2] ** 2 + deviations[:, 1::2] ** 2 + size / 2 * (left - right) ** 2)
            means, size = (left + right) / 2, 2 * size
            self.summary[level] = (size, means, deviations)

    @classmethod
    def unpacked(cls, row: dict) -> Rows:
        n, flat = row["n"], lambda name, kind: np.frombuffer(row[name], dtype=kind)
        wide = lambda name: flat(name, "<f8").reshape(n, -1)
        narrow = len(row["vectors"]) == 4 * n * row["dims"]
        vectors = flat("vectors", "<f4" if narrow else "<f8").astype(np.float64).reshape(n, row["dims"])
        return cls(flat("rids", "<i8"), flat("ids", "<i8"), flat("unnamed", "?"), flat("labels", "<i8"),
                   vectors, wide("means"), wide("deviations"))

    def part(self, a: int, b: int) -> Rows:
        finest = self.summary[LEVELS[-1]]
        return Rows(*(x[a:b] for x in (self.rids, self.ids, self.unnamed, self.labels, self.vectors, *finest[1:])))


def _scores(a: np.ndarray, b: np.ndarray, paired: bool) -> np.ndarray:
    """Exact inner products as 64-bit numbers: of all rows of ``a`` with all of
    ``b``, or of rows in pairs.  Beyond 64 bits they stop at the largest."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (np.einsum("ij,ij->i", a, b) if paired else a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    a, b = whole(a), whole(b)
    got = (a * b).sum(axis=1) if paired else a.dot(b.T)
    return np.clip(got, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def _within(a: Rows, b: Rows, may: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in ``a``, place in ``b``, score) of the pairs ``may`` whose
    score lies from ``least`` to ``most`` of the place in ``a``."""
    pairs = None  # dense while None
    for level in LEVELS:
        size, means, deviations = (np.asarray(x) for x in a.summary[level])
        _, other_means, other_deviations = b.summary[level]
        if pairs is None:
            middle = size * (means @ other_means.T)
            reach = deviations @ other_deviations.T
            # Half a unit, as scores are whole, and the error of the sums themselves.
            reach += 0.5 + 1e-9 * (np.abs(middle) + reach)
            may = may & (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
            if np.count_nonzero(may) <= SPARSE * may.size:
                pairs = np.nonzero(may)
        else:
            i, j = pairs
            middle = size * np.einsum("ij,ij->i", means[i], other_means[j])
            reach = np.einsum("ij,ij->i", deviations[i], other_deviations[j])
            reach += 0.5 + 1e-9 * (np.abs(middle) + reach)
            left = (middle + reach >= least[i]) & (middle - reach <= most[i])
            pairs = i[left], j[left]
    if pairs is None:
        score = _scores(a.vectors, b.vectors, paired=False)
        i, j = np.nonzero(may & (score >= least[:, None]) & (score <= most[:, None]))
        return i, j, score[i, j]
    i, j = pairs
    score = _scores(a.vectors[i], b.vectors[j], paired=True)
    left = (score >= least[i]) & (score <= most[i])
    return i[left], j[left], score[left]


class Best:
    """The best ``k`` rows of each of ``n`` searches: by score, ties by id, rows without id last."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.held = [np.empty(0, dtype=np.int64) for _ in range(5)]  # search, score, unnamed, id, rid

    def add(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        rows = [np.concatenate(x) for x in zip(self.held, new, strict=True)]
        order = np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))
        rows = [x[order] for x in rows]
        head = np.r_[0, np.flatnonzero(np.diff(rows[0])) + 1]
        place = np.arange(len(rows[0])) - np.repeat(head, np.diff(np.r_[head, len(rows[0])]))
        self.held = [x[place < self.k] for x in rows]
        last = place == self.k - 1
        self.floor[rows[0][last]] = rows[1][last]

    def batch(self) -> pa.RecordBatch:
        search, score, unnamed, ids, rid = self.held
        return pa.RecordBatch.from_arrays(
            [pa.array(search), pa.array(score), pa.array(ids, mask=unnamed.astype(bool)), pa.array(rid)],
            names=["search", "score", "id", "rid"])


FOUND = "search long, score long, id long, rid long"


def _blocks(rows: DataFrame, dims: int, most: int) -> DataFrame:
    """``rows`` (rid, id, label, vector) packed in blocks of at most ``most`` rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            n = whole.num_rows
            vectors = np.zeros((n, dims))
            lists = whole.column(3).combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            vectors[np.repeat(np.arange(n), sizes), inside] = np.floor(256 * flat.astype(np.float64))
            ids = whole.column(1).combine_chunks()
            plain = lambda x: x.to_numpy(zero_copy_only=False).astype("<i8")
            unnamed = ids.is_null().to_numpy(zero_copy_only=False)
            rows = Rows(plain(whole.column(0)), plain(ids.fill_null(0)), unnamed, plain(whole.column(2)), vectors)
            _, means, deviations = rows.summary[LEVELS[-1]]
            # Whole numbers below 2**24 are exact in 32 bits.
            stored = vectors.astype("<f4") if np.abs(vectors).max(initial=0) < 2 ** 24 else vectors
            values = [n, dims, *(x.tobytes() for x in (rows.rids, rows.ids, unnamed, rows.labels, stored, means, deviations))]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              names=[x.split()[0] for x in PACKED.split(", ")])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, most - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.select("rid", "id", "label", "vector").mapInArrow(pack, PACKED)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """One block at a time, whatever number a batch has."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield Rows.unpacked({name: batch.column(name)[k].as_py() for name in batch.schema.names})


def _found(blocks: DataFrame, search) -> DataFrame:
    """What ``search`` (an iterator of blocks -> Best) holds after a task's blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield search(_each(batches)).batch()

    return blocks.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each search over all tasks, with their rank from 1."""
    order = Window.partitionBy("search").orderBy(F.desc("score"), F.col("id").isNull(), "id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND,
         chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows of ``df`` that meet ``anchor``: columns of RESULT.

    Each component x counts as floor(256 x), so scores are whole numbers.
    Defined results: rows with a null label or vector, or a component that is
    null or not finite, take no part.  Of vectors of different lengths the shorter
    counts as padded with zeros; an empty one scores 0.  A null id comes after all
    others; a row for which ``anchor`` is null is no anchor.  Rows that repeat an
    id are rows of their own: each is an anchor, and "other" means another row.
    Ties in score and id change nothing that is returned.  An anchor without
    positives, or a positive without negatives, gives no row; an empty table gives
    none.  Other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"),
                     F.coalesce(anchor, F.lit(False)).alias("is_anchor"), sound.alias("sound")) \
             .where("label IS NOT NULL AND vector IS NOT NULL AND sound").drop("sound") \
             .withColumn("rid", F.monotonically_increasing_id())
    rows = staged(rows, "negatives-rows")
    n_anchors, dims = rows.agg(F.count(F.when(F.col("is_anchor"), 1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dims = max(1, pieces(dims, LEVELS[-1])) * LEVELS[-1]
    blocks = staged(_blocks(rows, dims, block), "negatives-blocks")
    chunks = rows.where("is_anchor").repartition(pieces(n_anchors, chunk))
    chunks = staged(_blocks(chunks, dims, chunk).withColumn("chunk", F.monotonically_increasing_id()), "negatives-anchors")
    out = os.path.join(ensure_checkpoint_dir(spark), "tables", f"llm-negatives-{uuid.uuid4().hex}")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for number in sorted(r.chunk for r in chunks.select("chunk").collect()):
        one = chunks.where(F.col("chunk") == number).drop("chunk").first()
        _of_chunk(blocks, one.asDict(), positives, negatives, band).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)


def _of_chunk(blocks: DataFrame, packed: dict, positives: int, negatives: int, band: tuple[int, int]) -> DataFrame:
    spark = blocks.sparkSession
    n, sent = packed["n"], spark.sparkContext.broadcast(packed)

    def of_own_label(rows: Iterator[Rows]) -> Best:
        anchors, best = Rows.unpacked(sent.value), Best(n, positives)
        tiles = [(a, anchors.part(a, a + TILE)) for a in range(0, n, TILE)]
        for other in rows:
            for at, own in tiles:
                may = (own.labels[:, None] == other.labels) & (own.rids[:, None] != other.rids)
                i, j, score = _within(own, other, may, best.floor[at:at + TILE], np.full(len(own.rids), np.inf))
                best.add(i + at, score, other.unnamed[j].astype(np.int64), other.ids[j], other.rids[j])
        return best

    # At most ``positives`` rows for each anchor of the chunk.
    own = staged(_merged(_found(blocks, of_own_label), positives), "negatives-positives")
    own = sorted(((r.search, r.rank, r.id, r.score) for r in own.collect()), key=lambda r: r[:2])
    anchor_of = np.array([r[0] for r in own], dtype=np.int64)
    scores = [r[3] for r in own]
    # The band in whole scores; for a score under 0 it is empty.
    least = np.array([-(-band[0] * s // 100) for s in scores], dtype=np.float64)
    most = np.array([band[1] * s // 100 for s in scores], dtype=np.float64)
    bands = spark.sparkContext.broadcast((anchor_of, least, most))

    def of_other_labels(rows: Iterator[Rows]) -> Best:
        anchors, (anchor_of, least, most) = Rows.unpacked(sent.value), bands.value
        best = Best(len(anchor_of), negatives)
        use = np.flatnonzero(least <= most)
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.maximum.at(high, anchor_of[use], most[use])
        tiles = [(a, anchors.part(a, a + TILE)) for a in range(0, n, TILE)]
        heads = np.searchsorted(anchor_of, np.arange(n + 1))
        width = int(np.diff(heads).max(initial=0))
        for other in rows:
            low[:] = np.inf
            np.minimum.at(low, anchor_of[use], np.maximum(least, best.floor)[use])
            for at, own in tiles:
                may = own.labels[:, None] != other.labels
                i, j, score = _within(own, other, may, low[at:at + TILE], high[at:at + TILE])
                for k in range(width):  # the k-th positive of each pair's anchor
                    search = heads[i + at] + k
                    known = search < heads[i + at + 1]
                    search = np.where(known, search, 0)
                    fits = known & (score >= np.maximum(least, best.floor)[search]) & (score <= most[search])
                    best.add(search[fits], score[fits], other.unnamed[j[fits]].astype(np.int64), other.ids[j[fits]], other.rids[j[fits]])
        return best

    ids = np.frombuffer(packed["ids"], dtype="<i8")[anchor_of].tolist()
    unnamed = np.frombuffer(packed["unnamed"], dtype="?")[anchor_of].tolist()
    named = [(k, None if u else i, positive, score) for k, (i, u, (_, _, positive, score)) in
             enumerate(zip(ids, unnamed, own, strict=True))]
    searches = spark.createDataFrame(named, "search long, anchor_id long, positive_id long, positive_score long")
    best = _merged(_found(blocks, of_other_labels), negatives)
    return best.join(F.broadcast(searches), "search").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def op11_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor of ``embeddings``."""
    label = F.col("label").cast("long")
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=moved)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS rid
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.rid ORDER BY s.score DESC, s.vec_id, s.rid) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
