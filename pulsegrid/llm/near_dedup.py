"""Near-duplicates by b-bit MinHash (operator 6).

1. *Signatures.*  Each text becomes its set of distinct five-word shingles; of
   ``ROWS * BANDS`` hash functions the minima are taken.  ``BITS`` low bits of
   each minimum are packed into longs; the full minima of each band give one
   64-bit bucket number.  Texts with equal word sequences are one class from
   here on, so copies are never expanded into pairs.
2. *Candidates.*  Classes that share a bucket are candidates.  Buckets are not
   expanded into pairs: each names one leader, its most central member (the
   one with most bucket neighbours), and every other member is paired with it,
   so the pairs grow with the members.
3. *Estimate.*  XOR and bit counts of two packed signatures give the share of
   equal b-bit minima, P.  Equal bits also come by chance, C = 2**-b of the
   time, so the similarity is (P - C) / (1 - C).  Pairs far below the
   threshold go (``MARGIN``, about five standard deviations).
4. *Confirmation* on the full shingle sets.
5. *The rest, exactly.*  Confirmed links give components.  Only buckets that
   still hold several components can hide a link that matters; there, members
   outside the leader's component are compared with all members of other
   components by their signatures, in blocks of bounded size, and what passes is
   confirmed in the block.  A block returns links that join components, never
   pairs; links inside one component are not needed for its id.
6. *Components* by alternating large-star and small-star steps over staged edge
   tables.

No bucket, leader or component is ever collected in one place: bucket facts are
aggregates, hot joins split by salt blocks or by the skew-join rule, and
confirmation runs on a grid of cells of bounded size.  With 4 rows and 32 bands,
a pair at similarity 0.75 shares no bucket with probability 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import pieces, staged, table

SHINGLE = 5
#: Linked at 100 * intersection >= PERCENT * union.
PERCENT = 75
ROWS, BANDS, BITS = 4, 32, 4
MARGIN = 0.2
SEED = 20240217
#: Documents that one block of stage 5 compares on each side.
BLOCK = 512
#: Bytes of text that one cell of the confirmation holds on each side (or one
#: larger document), and what a document counts besides its text.
CELL_BYTES, DOC_BYTES = 4_000_000, 500

SIGNATURE = "n_shingles long, word_class binary, buckets array<long>, packed array<long>"


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (xor-multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, hashes: dict[bytes, int], width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle numbers of a lower-cased text; with fewer
    words than ``width`` the whole sequence is the one shingle."""
    words = text.split()  # on ASCII white space, as these are bytes
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for k in range(min(width, len(words))):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(out)


def _functions(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2 ** 63, count, dtype=np.uint64) * 2 + 1, rng.integers(0, 2 ** 63, count, dtype=np.uint64)


def minima(shingle_set: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingle_set), 512):
        np.minimum(out, (shingle_set[a:a + 512, None] * factors + offsets).min(axis=0), out=out)
    return out


def pack(minimum: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` bits of (mixed) minima, 64 // bits of them to a long."""
    per = 64 // bits
    low = (_mixed(minimum) & np.uint64(2 ** bits - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=np.uint64) * np.uint64(bits)), axis=1)


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS,
               bands: int = BANDS, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """Per row its id and the columns of SIGNATURE; texts without words have an
    empty set, a null class and no buckets."""
    ready = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = T.StructType.fromDDL("doc_id long, " + SIGNATURE)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(fields)
        hashes = _WordHashes()
        factors, offsets = _functions(SEED, rows * bands)
        band_mix = _mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                out = []
                for scalar in texts.slice(at, 256):
                    text = (scalar.as_py() or "").encode().lower()
                    found = shingles(text, hashes, width)
                    if not len(found):
                        out.append((0, None, [], []))
                        continue
                    low = minima(found, factors, offsets)
                    bucket = band_mix
                    for k in range(rows):
                        bucket = _mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + low.reshape(bands, rows)[:, k])
                    words = hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()
                    out.append((len(found), words, bucket.view(np.int64), pack(low, bits).view(np.int64)))
                columns = [ids.slice(at, 256), *(pa.array(list(c), kind.field(k + 1).type) for k, c in enumerate(zip(*out)))]
                yield pa.RecordBatch.from_arrays([c.cast(kind.field(k).type) for k, c in enumerate(columns)], schema=kind)

    return ready.mapInArrow(signed, fields)


def estimate(a: Column, b: Column, count: int, bits: int) -> Column:
    """Collision-corrected similarity of two packed signatures of ``count`` minima."""
    ones = sum(1 << (k * bits) for k in range(64 // bits))
    mask = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones).cast("long")
    unequal = F.lit(0)
    for k in range(count * bits // 64):
        differ = a[k].bitwiseXOR(b[k])
        folded = differ
        for step in range(1, bits):  # a field of the result is odd where any of its bits differs
            folded = folded.bitwiseOR(F.shiftrightunsigned(differ, step))
        unequal = unequal + F.bit_count(folded.bitwiseAND(mask))
    chance = 2.0 ** -bits
    return (1 - unequal / count - chance) / (1 - chance)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """Of ``pairs`` (a, b, near) those whose full sets are linked.  ``texts``:
    doc_id, text, text_bytes of at least their documents.  Pairs with the same
    ``near`` are looked at together, so that a text travels once for many pairs;
    a large ``near`` is dealt over a square grid, small ones share cells.  A cell
    thus holds bounded bytes, and each text only goes where it has a pair."""
    near = pairs.select("near", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    size = near.join(texts.select("doc_id", "text_bytes"), "doc_id").groupBy("near") \
               .agg(F.sum(F.col("text_bytes") + DOC_BYTES).alias("bytes"))
    size = staged(size.withColumn("grid", F.ceil(F.col("bytes") / CELL_BYTES)), "cells")
    shared = pieces(size.where("grid = 1").agg(F.sum("bytes")).first()[0] or 0, CELL_BYTES)
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED)), F.col("grid"))
    cell = F.when(F.col("grid") > 1, F.xxhash64("near", side("a"), side("b"))).otherwise(
        F.pmod(F.xxhash64("near"), F.lit(shared)))
    placed = staged(pairs.join(size, "near").select("a", "b", cell.alias("cell")), "placed")
    wanted = placed.select(F.col("cell").alias("at"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sent = wanted.join(texts.select("doc_id", "text"), "doc_id")

    def linked(key, mine: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        hashes = _WordHashes()
        sets: dict[int, list[np.ndarray]] = {}
        for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
            sets.setdefault(doc, []).append(shingles((text or "").encode().lower(), hashes, width))
        keep = [any(_linked(x, y, percent) for x in sets[a] for y in sets[b])
                for a, b in zip(mine["a"], mine["b"], strict=True)]
        return mine.loc[keep, ["a", "b"]]

    return placed.groupBy("cell").cogroup(sent.groupBy("at")).applyInPandas(linked, "a long, b long")


def _observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` staged, and their count and sum of hashes, taken on the way."""
    seen = Observation()
    kept = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges")
    if kept.isEmpty():  # without rows nothing is observed
        return kept, (0, None)
    return kept, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b), the component being
    its smallest node.  Large-star and small-star steps until the edges stay."""
    now, state = _observed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                           .where("u <> v").distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Staged before it is joined: a node with very many edges is then a
        # skewed join, which Spark splits.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # From here on a node has an edge to each of its neighbours' minima only.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        now, seen = _observed(small)
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = seen


def _across(region: DataFrame, texts: DataFrame, cut: float, count: int, bits: int, percent: int, width: int) -> DataFrame:
    """Links between components inside regions.  ``region``: main, doc_id,
    component, outside, packed; a region is the documents of all open buckets
    whose leaders are in component ``main``, so it holds every pair that shares
    one of those.  Documents outside the main component meet all others in blocks
    of bounded documents and bytes; a block compares signatures, confirms what
    passes, best estimates first, and returns the links that join components it
    hadn't joined yet: at most one per document."""
    sized = region.join(texts.groupBy("doc_id").agg(F.sum("text_bytes").alias("text_bytes")), "doc_id")
    sizes = sized.groupBy("main").agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_bytes").alias("bytes"), F.count_if("outside").alias("n_out"),
        F.sum(F.when(F.col("outside"), F.col("text_bytes")).otherwise(0)).alias("bytes_out"))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / CELL_BYTES), F.lit(1))
    sizes = staged(sizes.select("main", "n", blocks("n_out", "bytes_out").alias("lefts"), blocks("n", "bytes").alias("rights")), "region-sizes")
    shared = pieces(sizes.where("lefts = 1 AND rights = 1").agg(F.sum("n")).first()[0] or 0, BLOCK)
    cell = F.when((F.col("lefts") == 1) & (F.col("rights") == 1), F.pmod(F.xxhash64("main"), F.lit(shared))) \
            .otherwise(F.xxhash64("main", "i", "j"))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = region.join(sizes.drop("n"), "main")
    left = rows.where("outside").withColumn("i", own("lefts")).withColumn("j", every("rights")).withColumn("left", F.lit(True))
    right = rows.withColumn("j", own("rights")).withColumn("i", every("lefts")).withColumn("left", F.lit(False))
    dealt = left.unionByName(right).select(cell.alias("cell"), "main", "left", "doc_id", "component", "packed", "n_shingles")
    dealt = dealt.join(texts.select("doc_id", "text"), "doc_id")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, of_region in rows.groupby("main"):
            out += _block_links(of_region, cut, count, bits, percent, width)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("cell").applyInPandas(block, "a long, b long")


def _block_links(rows: pd.DataFrame, cut: float, count: int, bits: int, percent: int, width: int) -> list[tuple[int, int]]:
    texts: dict[int, list[str]] = {}
    for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
        own = texts.setdefault(doc, [])
        if text not in own:
            own.append(text)
    hashes, sets = _WordHashes(), {}
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    def set_of(doc: int) -> list[np.ndarray]:
        if doc not in sets:
            sets[doc] = [shingles((t or "").encode().lower(), hashes, width) for t in texts[doc]]
        return sets[doc]

    # An id with several texts has a row, and a signature, for each.
    rows = rows.assign(key=[x.tobytes() for x in rows["packed"]]).drop_duplicates(["left", "doc_id", "component", "n_shingles", "key"])
    sides = [rows[rows["left"]], rows[~rows["left"]]]
    (xs, cx, nx, px), (ys, cy, ny, py) = ((r["doc_id"].to_numpy(), r["component"].to_numpy(), r["n_shingles"].to_numpy(np.int64),
                                           np.array(r["packed"].tolist(), dtype=np.int64).view(np.uint64)) for r in sides)
    out = []
    ones = np.uint64(sum(1 << (k * bits) for k in range(64 // bits)))
    chance = 2.0 ** -bits
    for at in range(0, len(xs), 64):
        differ = px[at:at + 64, None, :] ^ py[None, :, :]
        folded = differ.copy()
        for step in range(1, bits):
            folded |= differ >> np.uint64(step)
        unequal = np.bitwise_count(folded & ones).sum(axis=2)
        similar = (1 - unequal / count - chance) / (1 - chance)
        mine, theirs = nx[at:at + 64, None], ny[None, :]
        similar[(cx[at:at + 64, None] == cy[None, :])
                | (100 * np.minimum(mine, theirs) < percent * np.maximum(mine, theirs))] = -1.0  # too unlike in size to be linked
        first, second = np.nonzero(similar >= cut)
        for k in np.argsort(-similar[first, second], kind="stable"):
            x, y = at + first[k], second[k]
            a, b = root(cx[x]), root(cy[y])
            if a != b and any(_linked(s, t, percent) for s in set_of(xs[x]) for t in set_of(ys[y])):
                parent[max(a, b)] = min(a, b)
                out.append((int(xs[x]), int(ys[y])))
    return out


def _leader_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members``: bucket, doc_id, size (of the bucket).  Each bucket's leader,
    and the pairs of leaders with the other members."""
    central = members.groupBy("doc_id").agg(F.sum("size").alias("near"))
    ranked = members.join(central, "doc_id")
    leaders = staged(ranked.groupBy("bucket").agg(
        F.max(F.struct("near", (-F.col("doc_id")).alias("least"))).alias("top"))
        .select("bucket", (-F.col("top.least")).alias("leader")), "leaders")
    pairs = members.join(leaders, "bucket").where("doc_id <> leader") \
                   .groupBy(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")) \
                   .agg(F.min("leader").alias("near"))
    return leaders, pairs


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                rows: int = ROWS, bands: int = BANDS, bits: int = BITS, width: int = SHINGLE,
                margin: float = MARGIN) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id
    it is linked to, directly or through others, or its own) and ``kept``.

    Defined results: a null, empty or blank text has an empty set, links with
    nothing and is kept.  A null id can't be linked to; its row gets a null
    component and is kept.  Rows that repeat an id are one document: their links
    are joined and all are reported.  Other columns are ignored; an empty table
    gives no rows.  ``width``: words of a shingle; ``bits`` divides 64.
    """
    count, cut = rows * bands, percent / 100 - margin
    signed = staged(signatures(df, id_col, text_col, rows, bands, bits, width), "signatures")
    named = signed.where("word_class IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("word_class").agg(F.min("doc_id").alias("rep"))
    held = staged(named.select("doc_id", "word_class").distinct().join(classes, "word_class")
                  .select("doc_id", "rep"), "classes")
    # An id with several texts belongs to several classes, which it links.
    several = held.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    joint = held.join(several, "doc_id", "left_semi").where("doc_id <> rep") \
                .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = named.join(held.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi") \
                .groupBy("doc_id", "word_class").agg(F.first("buckets").alias("buckets"), F.first("packed").alias("packed"),
                                                     F.first("n_shingles").alias("n_shingles"))
    member = reps.select("doc_id", F.explode("buckets").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = staged(member.join(sizes, "bucket"), "members")
    touched = members.select("doc_id").distinct()
    packed = staged(reps.join(touched, "doc_id", "left_semi").select("doc_id", "packed", "n_shingles"), "packed")
    texts = staged(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                   .join(touched, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
                   .withColumn("text_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "texts")

    def passing(pairs: DataFrame) -> DataFrame:
        left = packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("pa"), F.col("n_shingles").alias("na"))
        right = packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("pb"), F.col("n_shingles").alias("nb"))
        # Sets too unlike in size can't be linked, whatever they share.
        return pairs.join(left, "a").join(right, "b") \
                    .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) \
                    .where(estimate(F.col("pa"), F.col("pb"), count, bits) >= cut) \
                    .groupBy("a", "b").agg(F.min("near").alias("near"))

    leaders, first = _leader_pairs(members)
    first = staged(passing(first), "pairs")
    links = staged(confirmed(first, texts, percent, width), "links")
    links = links.union(joint)
    found = staged(components(links), "components")

    # Stage 5: buckets of several components.
    label = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
                   .withColumn("component", F.coalesce("component", "doc_id"))
    of_leader = label.join(leaders.withColumnRenamed("leader", "doc_id"), ["bucket", "doc_id"], "left_semi") \
                     .select("bucket", F.col("component").alias("main")).distinct()
    label = label.join(of_leader, "bucket").withColumn("outside", F.col("component") != F.col("main"))
    label = staged(label.select("bucket", "doc_id", "component", "main", "outside"), "labels")
    open_ = label.where("outside").select("bucket").distinct()
    region = label.join(open_, "bucket", "left_semi") \
                  .groupBy("main", "doc_id", "component").agg(F.max("outside").alias("outside"))
    region = staged(region.join(packed, "doc_id"), "regions")
    if not region.isEmpty():
        links = links.union(staged(_across(region, texts, cut, count, bits, percent, width), "links"))
        found = staged(components(links), "components")

    of_class = held.join(found.withColumnRenamed("node", "rep"), "rep", "left") \
                   .select("doc_id", F.coalesce("component", "rep").alias("component")) \
                   .groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = signed.select("doc_id", "n_shingles").join(of_class, "doc_id", "left") \
                .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id",
                      (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def op6_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``, one row per document."""
    return near_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id
                    GROUP BY 1, 2) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
