"""Lexical retrieval packing (operator 2).

Documents become token ids (a public vocabulary, then the end id).  Windows of
``WINDOW`` ids that a long document fills alone are sequences at once; what is
left of each document, under one window, is an open remainder.

Each shard is a BM25 inverted index over ``SHARD`` remainders, with token ids as
terms, and the inverse document frequencies and mean length of *all* windows and
remainders.  A seed (the next unused remainder) queries the index by all its
terms and gets the unused neighbours by score; these fill its window greedily.
The one that doesn't fit is cut, and what is left of it stays unused.  Where no
neighbour scores, the next unused remainders fill in.  The end of a shard, less
than a window, becomes sequences whose lengths are powers of two, so nothing is
padded.

A seed asks its own shard, so remainders that share rare terms are dealt to the
same one: they are put in the order of their topic (the nearest of ``TOPICS``
centres, fitted on a sample of about ``SAMPLE`` remainders), then of ``ORDERS``
weighted min-hashes of their terms, and the order is cut into shards.  Two
remainders have the same min-hash with the probability of their similarity
weighted by inverse document frequency, at every size of the corpus.

A shard is bounded by rows and each row by a window (full windows travel as
check sums, or with their ids where asked for).  What reaches the driver is one
count per vocabulary entry and the sample.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import byte_slices, ranked, staged, table

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
VOCABULARY_SIZE = 50_257
END = 1
WINDOW = 2048
SHARD = 4096
TOPICS, SAMPLE, ROUNDS = 16, 4096, 6
ORDERS = 3
#: Bytes of text whose different words are merged once.
SLICE_BYTES = 8_000_000
#: Kinds of characters: text end, letter, digit, white space, other.
NONE, LETTER, DIGIT, WHITE, OTHER = range(5)
#: Neighbours that are put in order at first; more where a window takes more.
FIRST = 32
K1, B = 1.2, 0.75

TOKENS = "row long, doc_id long, doc_tokens long, full_crc array<long>, full_terms binary, full_ids binary, rest binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _kind(character: str) -> int:
    if character == "\0":
        return NONE
    if character.isspace():
        return WHITE
    return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(character)[0], OTHER)


class Tokeniser:
    """Ids of the ``tokenizers`` vocabulary.  Ordinary Latin texts are cut into
    words together, by kinds of characters as the vocabulary's pattern cuts them;
    tiktoken, which holds the same vocabulary, merges each different word once.
    All else, and texts with the special token, goes by ``tokenizers`` itself."""

    def __init__(self, folder: str | None):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        place = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.vocabulary, self.full = place(VOCABULARY), None
        with open(place(RANKS), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.cut = ranks[b"\0"]
        self.fast = tiktoken.Encoding("own", pat_str=r"[^\x00]+|\x00", mergeable_ranks=ranks, special_tokens={})
        self.plain = re.compile(r"[\n\t\r\x20-\x7e¡-ɏ‐-‧]*")
        self.kinds = np.array([_kind(chr(c)) for c in range(0x2028)], dtype=np.uint8)

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0][:-1]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, then the end id."""
        plain = [k for k, t in enumerate(texts) if self.plain.fullmatch(t) and SPECIAL not in t]
        out = dict(zip(plain, self._latin([texts[k] for k in plain]), strict=True))
        return [out[k] if k in out else np.append(self._any(t), np.uint16(END)) for k, t in enumerate(texts)]

    def _any(self, text: str) -> np.ndarray:
        if self.full is None:  # few corpora need it, and it takes memory
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.vocabulary)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _latin(self, texts: list[str]) -> list[np.ndarray]:
        """The same of texts that ``plain`` matches.  A zero byte after each text
        is a word of its own, which stands for the end id."""
        if not texts:
            return []
        data = ("\0".join(texts) + "\0").encode()
        starts = np.flatnonzero(self._starts(np.frombuffer(data, dtype=np.uint8))).astype(np.int32)
        offsets = np.append(starts, np.int32(len(data)))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code, (ids, first, sizes) = words.indices.to_numpy(), self._merged(words.dictionary)
        n = sizes[code]
        after = np.cumsum(n, dtype=np.int32)
        ids = ids[np.arange(after[-1], dtype=np.int32) + np.repeat(first[code] - after + n, n)]
        return np.split(ids, after[np.frombuffer(data, dtype=np.uint8)[starts] == 0][:-1])

    def _starts(self, data: np.ndarray) -> np.ndarray:
        """Of each byte, whether a word starts at it."""
        kind = self.kinds[data]
        for at in (np.flatnonzero(data >> 5 == 6), np.flatnonzero(data >> 4 == 14)):  # characters of two and three bytes
            if len(at):
                wide = data[at[0]] >> 4 == 14
                code = (data[at] & (15 if wide else 31)).astype(np.int64)
                for k in range(1, 3 if wide else 2):
                    code = code << 6 | data[at + k] & 63
                for k in range(3 if wide else 2):
                    kind[at + k] = self.kinds[code]
        white = kind == WHITE
        start = np.ones(len(data), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) & (white[1:] | (data[:-1] != 32)) | (kind[1:] == NONE)
        # The last of the white space before a word is cut off.
        start[:-1] |= white[:-1] & ~white[1:] & (kind[1:] != NONE)
        short = np.flatnonzero(start & (data == 39))
        for k, endings in ((2, b"stmd"), (3, (b"re", b"ve", b"ll"))):
            at = short[short + k < len(data)]
            if k == 2:
                at = at[np.isin(data[at + 1], np.frombuffer(endings, dtype=np.uint8))]
            else:
                at = at[np.any([(data[at + 1] == a) & (data[at + 2] == b) for a, b in endings], axis=0)]
            start[at + 1] = False
            start[at + k] = True
        return start

    def _merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``words``, and of each word its first place in them and its number of ids."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b"\0")[0].as_py()
        ids = np.array(self.fast.encode_ordinary(text.decode()), dtype=np.uint16)
        cuts, end = np.flatnonzero(ids == self.cut), pc.index(words, pa.scalar(b"\0", words.type)).as_py()
        ids[cuts[end]] = END
        cuts = np.delete(cuts, end).astype(np.int32)
        first = np.append(np.int32(0), cuts + np.int32(1))
        return ids, first, np.append(cuts, np.int32(len(ids))) - first


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def distinct(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each of ``ids`` once; ``last`` is room for a number per vocabulary entry."""
    at = np.arange(len(ids))
    last[ids] = at
    return ids[last[ids] == at]


def tokenised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
              with_ids: bool = False, tokenizers: str | None = None) -> DataFrame:
    """One row per document, columns TOKENS; ids as little-endian 16-bit numbers."""
    ready = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    fields = T.StructType.fromDDL(TOKENS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, tokens, last = to_arrow_schema(fields), None, np.zeros(VOCABULARY_SIZE, dtype=np.int64)
        for batch in batches:
            tokens = tokens or Tokeniser(tokenizers)
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for a, b in byte_slices(sizes, SLICE_BYTES):
                part = batch.slice(a, b - a)
                n, crcs, terms, whole, rest = [], [], [], [], []
                for ids in tokens.many([text or "" for text in part.column(2).to_pylist()]):
                    full = len(ids) // window * window
                    n.append(len(ids))
                    crcs.append([crc(ids[k:k + window]) for k in range(0, full, window)])
                    terms.append(b"".join(distinct(ids[k:k + window], last).astype("<u2").tobytes() for k in range(0, full, window)))
                    whole.append(ids[:full].astype("<u2").tobytes() if with_ids else None)
                    rest.append(ids[full:].astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(x, kind.field(k + 2).type) for k, x in enumerate((n, crcs, terms, whole, rest)))],
                    schema=kind)

    return ready.mapInArrow(cut, fields)


def _document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Of all full windows and open remainders, how many have each id: one count
    per vocabulary entry, summed per task first."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, last = np.zeros((2, VOCABULARY_SIZE), dtype=np.int64)
        for batch in batches:
            terms = [distinct(np.frombuffer(x.as_py(), dtype="<u2"), last) for x in batch.column(0)]
            terms += [np.frombuffer(x, dtype="<u2") for x in batch.column(1).to_pylist() if x]
            if terms:
                found += np.bincount(np.concatenate(terms), minlength=VOCABULARY_SIZE)
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[ids])], names=["id", "n"])

    out = np.zeros(VOCABULARY_SIZE, dtype=np.int64)
    for i, n in tokens.select("rest", "full_terms").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _centres(sample: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Topics of ``sample`` by spherical k-means: of each vocabulary entry its
    weight in every centre (times its inverse document frequency)."""
    vectors = []
    for ids in sample:
        if len(ids):
            terms, tf = np.unique(ids, return_counts=True)
            weight = tf * idf[terms]
            vectors.append((terms, weight / max(1e-9, float(np.linalg.norm(weight)))))
    count = max(1, min(TOPICS, len(vectors)))
    centres = np.zeros((VOCABULARY_SIZE, count))
    for c, k in enumerate(np.random.default_rng(1).permutation(len(vectors))[:count]):
        centres[vectors[k][0], c] = vectors[k][1]
    for _ in range(ROUNDS):
        moved = np.zeros_like(centres)
        for terms, weight in vectors:
            moved[terms, np.argmax(weight @ centres[terms])] += weight
        size = np.linalg.norm(moved, axis=0)
        centres = np.where(size > 0, moved / np.maximum(size, 1e-9), centres)
    return (centres * idf[:, None]).astype(np.float32)


def _routed(rests: list[np.ndarray], centres: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Topic and min-hash terms of each remainder (0 for an empty one)."""
    topics = [int(np.argmax(np.ones(len(r), dtype=np.float32) @ centres.take(r, axis=0))) if len(r) else 0 for r in rests]
    order = [np.argsort(h, kind="stable") for h in hashes]
    ranks = [np.argsort(o).astype(np.uint16) for o in order]  # the least rank is the least hash
    return topics, [[int(o[rank.take(r).min()]) if len(r) else 0 for r in rests] for o, rank in zip(order, ranks, strict=True)]


def _hashes(idf: np.ndarray) -> np.ndarray:
    """``ORDERS`` weighted hashes of each vocabulary entry: exponential, of rate idf."""
    return np.random.default_rng(2).exponential(size=(ORDERS, VOCABULARY_SIZE)) / np.maximum(idf, 1e-9)


def _dealt(tokens: DataFrame, count: int, shard: int, idf: np.ndarray) -> DataFrame:
    """``tokens`` with ``place`` in the order of what the remainders share, and ``shard``."""
    step = max(1, round(count / SAMPLE))
    sample = tokens.where(F.pmod(F.xxhash64("row"), F.lit(step)) == 0).select("row", "rest").collect()
    centres = _centres([np.frombuffer(r["rest"], dtype="<u2") for r in sorted(sample, key=lambda r: r["row"])], idf)
    hashes = _hashes(idf)
    names = ["row", "topic", *[f"h{k}" for k in range(ORDERS)]]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, terms = _routed([np.frombuffer(x.as_py(), dtype="<u2") for x in batch.column(1)], centres, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int32()) for x in (topics, *terms)]], names=names)

    schema = "row long, " + ", ".join(f"{n} int" for n in names[1:])
    routes = staged(tokens.select("row", "rest").mapInArrow(route, schema), "token-routes")
    placed = ranked(routes, *[F.col(n) for n in (*names[1:], "row")], out="place")
    placed = placed.select("row", "place", F.floor(F.col("place") / shard).alias("shard"))
    return tokens.drop("full_terms").join(placed, "row")


class Index:
    """BM25 postings of one shard: for each id the remainders that have it and
    the weight it gives them."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(r) for r in rests], dtype=np.int64)
        self.n = len(rests)
        kind = np.uint32 if self.n <= 1 << 16 else np.int64
        flat = np.concatenate(rests).astype(kind) if rests else np.zeros(0, dtype=kind)
        pair, tf = np.unique(np.repeat(np.arange(self.n, dtype=kind), sizes) << kind(16) | flat, return_counts=True)
        owner, term = (pair >> kind(16)).astype(np.int64), (pair & kind(0xFFFF)).astype(np.int64)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / mean))
        self.first = np.searchsorted(owner, np.arange(self.n + 1))
        self.terms, self.weight = term, weight
        by_term = np.argsort(term.astype(np.uint16), kind="stable")
        owner, weight = owner[by_term], weight[by_term]
        at = np.searchsorted(term[by_term], np.arange(VOCABULARY_SIZE + 1))
        # A word in an eighth of the remainders and more has a row of weights, not postings.
        dense = np.flatnonzero(np.diff(at) * 8 > self.n)
        self.row = np.full(VOCABULARY_SIZE, -1)
        self.row[dense] = np.arange(len(dense))
        self.rows = np.zeros((len(dense), self.n))
        for k, t in enumerate(dense):
            self.rows[k, owner[at[t]:at[t + 1]]] = weight[at[t]:at[t + 1]]
        self.alive, self.owner, self.score, self.at = np.arange(self.n), owner, weight, at

    def best_first(self, seed: int, unused: np.ndarray, count: int | None = None) -> Iterator[int]:
        """Unused remainders by falling score for the seed's terms (its ``count``
        heaviest, where given), ties in their order; put in order as far as asked."""
        a, b = self.first[seed], self.first[seed + 1]
        terms = self.terms[a:b]
        if count is not None:
            terms = terms[np.argsort(-self.weight[a:b], kind="stable")[:count]]
        row = self.row[terms]
        scores = np.zeros(len(self.alive))
        for k in row[row >= 0].tolist():  # one by one: a copy of them all is more to move than to add
            scores += self.rows[k]
        spans = [slice(self.at[t], self.at[t + 1]) for t in terms[row < 0].tolist()]
        if spans:
            scores += np.bincount(np.concatenate([self.owner[s] for s in spans]),
                                  weights=np.concatenate([self.score[s] for s in spans]), minlength=len(scores))
        found = np.flatnonzero((scores > 0) & unused[self.alive])
        below, block = -scores[found], FIRST
        while len(found):
            now = below <= np.partition(below, block - 1)[block - 1] if len(found) > block else np.ones(len(found), dtype=bool)
            yield from self.alive[found[now]][np.argsort(below[now], kind="stable")].tolist()
            found, below, block = found[~now], below[~now], block * 8

    def neighbours(self, seed: int, unused: np.ndarray, count: int | None = None) -> np.ndarray:
        """All of ``best_first``."""
        return np.fromiter(self.best_first(seed, unused, count), dtype=np.int64)

    def forget(self, unused: np.ndarray) -> None:
        """Drop used remainders from postings and rows."""
        keep = unused[self.alive]
        left = keep[self.owner]
        self.at = np.concatenate([[0], np.cumsum(left)])[self.at]
        self.owner, self.score = (np.cumsum(keep) - 1)[self.owner[left]], self.score[left]
        self.alive, self.rows = self.alive[keep], np.ascontiguousarray(self.rows[:, keep])


def pack_shard(rests: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (remainder, start in it, length) that hold each id once."""
    index = Index(rests, idf, mean)
    size = np.array([len(r) for r in rests], dtype=np.int64)
    used = np.zeros(len(rests), dtype=np.int64)
    out, seed = [], 0
    while True:
        while seed < len(rests) and used[seed] == size[seed]:
            seed += 1
        if seed == len(rests):
            break
        unused = used < size
        if 4 * unused.sum() < 3 * len(index.alive):
            index.forget(unused)
        sequence, room = [], window

        def put(k: int) -> int:
            take = int(min(size[k] - used[k], room))
            sequence.append((k, int(used[k]), take))
            used[k] += take
            return take

        room -= put(seed)
        if room:
            for k in index.best_first(seed, used < size):
                room -= put(k)
                if not room:
                    break
        after = seed + 1
        while room and after < len(rests):
            if used[after] < size[after]:
                room -= put(after)
            after += 1
        out.append(sequence)
    return [part for sequence in out for part in _powers(sequence, window)]


def _powers(sequence: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """A full window as it is, a shorter sequence cut to powers of two."""
    total = sum(n for _, _, n in sequence)
    lengths = [window] if total == window else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    out, left = [], list(sequence)
    for length in lengths:
        part = []
        while length:
            k, start, n = left.pop(0)
            take = min(n, length)
            part.append((k, start, take))
            length -= take
            if take < n:
                left.insert(0, (k, start + take, n - take))
        out.append(part)
    return out


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD,
           with_ids: bool = True, tokenizers: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: columns
    PIECES, and with ``with_ids`` the piece's ``ids`` (little-endian 16-bit).

    Defined results: a null text is empty; an empty text is the end id alone.
    Rows that repeat an id are documents of their own that carry the same id; a
    null id is carried as null.  Other columns are ignored; an empty table gives
    no rows.  ``window`` is a power of two.
    """
    tokens = staged(tokenised(df, id_col, text_col, window, with_ids, tokenizers), "tokens")
    left = F.when(F.octet_length("rest") > 0, 1).otherwise(0)
    count, total, units = tokens.agg(F.count(F.lit(1)), F.sum("doc_tokens"), F.sum(F.size("full_crc") + left)).first()
    mean = (total or 0) / max(1, units or 0)
    frequency = _document_frequencies(tokens)
    idf = np.log1p(((units or 0) - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    fields = T.StructType.fromDDL(PIECES.replace("doc_id long", "doc_id string") + (", ids binary" if with_ids else ""))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        rests = [np.frombuffer(r, dtype="<u2") for r in rows["rest"]]
        ids, sizes = rows["doc_id"].tolist(), rows["doc_tokens"].tolist()
        sequence, out = int(key[0]) << 32, []
        for k, (crcs, whole) in enumerate(zip(rows["full_crc"], rows["full_ids"], strict=True)):
            for j, value in enumerate(crcs):
                out.append((ids[k], j * window, window, int(value), sizes[k], sequence, 0,
                            *([whole[2 * j * window:2 * (j + 1) * window]] if with_ids else [])))
                sequence += 1
        for parts in pack_shard(rests, idf, mean, window):
            offset = 0
            for k, start, n in parts:
                piece = rests[k][start:start + n]
                out.append((ids[k], sizes[k] - len(rests[k]) + start, n, crc(piece), sizes[k], sequence, offset,
                            *([piece.tobytes()] if with_ids else [])))
                offset += n
            sequence += 1
        return pd.DataFrame(out, columns=fields.names)

    # Ids as text: pandas would turn a long column with nulls into floats.
    dealt = _dealt(tokens, count, shard, idf).withColumn("doc_id", F.col("doc_id").cast("string"))
    return dealt.groupBy("shard").applyInPandas(pack, fields).withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"), with_ids=False)
