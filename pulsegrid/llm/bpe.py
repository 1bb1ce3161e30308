"""BPE encoding and decoding (operator 12).

A public vocabulary (loaded, never trained) is applied to whole texts.  Each
word of a text starts as one symbol per byte; of all neighbouring pairs the one
of lowest rank is merged, the leftmost where it occurs more than once, until no
pair is left that the vocabulary merges.  The method: the ranks of the
neighbouring pairs are the leaves of a segment tree of minima.  Its root is the
next merge, and a merge changes three leaves at most, so a word of n symbols
costs n log n however long it is.  Short words, whose trees have the same width, take
their steps together as array arithmetic.

Normalisation and the cut of a text into words are those of the vocabulary
file, done by the tokenizers library.  As neither looks across ASCII white
space, texts are first cut there, and each distinct word of a slice is encoded
once (up to ``MEMO_WORDS`` are kept for the next slices, which only saves time).  Nothing is
shuffled; memory is bounded by one slice of a batch and the memo.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import added, column, table

VOCABULARY = "word_bpe_49k.json"
MEMO_WORDS = 200_000
#: Words of one width of tree, up to this one, are merged together; longer words alone.
FOREST_WIDTH = 64
#: Leaves of the trees that are worked on together.
FOREST_LEAVES = 1 << 19
#: Words that the library normalises and cuts in one call.
JOINT_WORDS = 256
#: ASCII marks that are a piece of their own after letters.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: bytes
    that print as Latin-1 are their own letter, the others follow from 256 on."""
    printing = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printing)}
    return [rest.get(b, chr(b)) for b in range(256)]


class PairTree:
    """Minima over the ranks of neighbouring pairs.  A leaf holds rank and place
    as one number, so the smaller place wins among equal ranks."""

    def __init__(self, ranks: list[int | None]):
        self.width = 1 << max(0, len(ranks) - 1).bit_length()
        self.least = [NEVER] * (2 * self.width)
        for place, rank in enumerate(ranks):
            if rank is not None:
                self.least[self.width + place] = rank * self.width + place
        for node in range(self.width - 1, 0, -1):
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def root(self) -> tuple[int, int] | None:
        """Lowest rank and its leftmost place, None if nothing is left to merge."""
        return None if self.least[1] == NEVER else divmod(self.least[1], self.width)

    def set(self, place: int, rank: int | None) -> None:
        least, node = self.least, self.width + place
        least[node] = NEVER if rank is None else rank * self.width + place
        while node > 1:
            node >>= 1
            value = min(least[2 * node], least[2 * node + 1])
            if least[node] == value:
                break
            least[node] = value


class Bpe:
    """The vocabulary of a file of the tokenizers library: byte-level BPE with word ends."""

    def __init__(self, folder: str | None = None, name: str = VOCABULARY):
        from tokenizers import Tokenizer

        if folder is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        else:
            path = os.path.join(folder, name)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model = stated["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [(self.ids[left], self.ids[right]) for left, right in model["merges"]]
        self.made = np.array([self.ids[left + right] for left, right in model["merges"]], dtype=np.int64)
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        keys = np.array([left << 32 | right for left, right in pairs], dtype=np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        #: First symbol of each byte, inside a word and as its last.
        self.inner, self.last = (np.array([self.ids[x + e] for x in letters], dtype=np.int64) for e in ("", end))
        self.byte_of = {x: b for b, x in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.tokens: list[str | None] = [None] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token

    def merged(self, symbols: list[int]) -> list[int]:
        """``symbols`` after all merges, always the leftmost of lowest rank."""
        n, rank = len(symbols), self.rank
        if n < 2:
            return symbols
        symbols = [*symbols]
        tree = PairTree([rank.get(pair) for pair in zip(symbols, symbols[1:])])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (best := tree.root()) is not None:
            at, gone = best[1], after[best[1]]
            follows = after[gone]
            symbols[at], symbols[gone], after[at] = int(self.made[best[0]]), -1, follows
            if gone < n - 1:
                tree.set(gone, None)
            if follows < n:
                before[follows] = at
            tree.set(at, rank.get((symbols[at], symbols[follows])) if follows < n else None)
            if before[at] >= 0:
                tree.set(before[at], rank.get((symbols[before[at]], symbols[at])))
        return [s for s in symbols if s >= 0]

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """What the leaves of the pairs hold; a symbol below 0 merges with nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0), self.order[at] * width + place, NEVER)

    def _forest(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """``merged`` for many words at once, one tree of ``width`` leaves each: row
        by row the symbols, -1 where there are none.  Trees take their steps
        together until none has a merge left."""
        n = len(symbols)
        if not len(self.keys):
            return symbols
        # One more column for the symbol beside the last, and one more leaf for its pair.
        symbols = np.c_[symbols, np.full(n, -1)]
        columns = np.arange(width + 2)
        after, before = np.tile(columns + 1, (n, 1)), np.tile(columns - 1, (n, 1))
        tree = np.full((n, 2 * width + 1), NEVER)
        tree[:, width:2 * width] = self._leaves(symbols[:, :-2], symbols[:, 1:-1], columns[:width], width)
        size = width // 2
        while size:
            tree[:, size:2 * size] = np.minimum(tree[:, 2 * size:4 * size:2], tree[:, 2 * size + 1:4 * size:2])
            size //= 2
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while len(row):
            rank, at = np.divmod(tree[row, 1], width)
            gone = after[row, at]
            follows = after[row, gone]
            symbols[row, at], symbols[row, gone], after[row, at] = self.made[rank], -1, follows
            before[row, follows] = at
            ahead = before[row, at]
            own = symbols[row, at]
            tree[row, width + gone] = NEVER
            tree[row, width + at] = self._leaves(own, symbols[row, follows], at, width)
            ahead_leaf = np.where(ahead < 0, width, ahead)
            tree[row, width + ahead_leaf] = np.where(ahead < 0, NEVER, self._leaves(symbols[row, ahead], own, ahead, width))
            # The three paths to the root; a node that is none of theirs stays as it is.
            three = np.concatenate([row, row, row])
            node = width + np.minimum(np.concatenate([gone, at, ahead_leaf]), width - 1)
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[three, node] = np.minimum(tree[three, 2 * node], tree[three, 2 * node + 1])
            row = row[tree[row, 1] < NEVER]
        return symbols[:, :-1]

    def pieces(self, words: list[bytes]) -> list[bytes]:
        """The ids, as 32-bit numbers, of words in bytes as the merges see them."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(sizes) - sizes
        classes = np.where(sizes > 1, np.ceil(np.log2(np.maximum(sizes - 1, 1))).astype(np.int64), 0)
        for c in np.unique(classes[sizes > 0]).tolist():
            width = 1 << c
            members = np.flatnonzero((classes == c) & (sizes > 0))
            if width > FOREST_WIDTH:
                for k in members.tolist():
                    own = self.inner[flat[starts[k]:starts[k] + sizes[k]]]
                    own[-1] = self.last[words[k][-1]]
                    out[k] = np.array(self.merged(own.tolist()), dtype=np.int32).tobytes()
                continue
            for a in range(0, len(members), max(1, FOREST_LEAVES // width)):
                some = members[a:a + max(1, FOREST_LEAVES // width)]
                n, size = len(some), sizes[some]
                symbols = np.full((n, width + 1), -1, dtype=np.int64)
                r = np.repeat(np.arange(n), size)
                col = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
                symbols[r, col] = self.inner[flat[starts[some][r] + col]]
                symbols[np.arange(n), size - 1] = self.last[flat[starts[some] + size - 1]]
                done = self._forest(symbols, width)
                left = done >= 0
                ids = done[left].astype(np.int32).tobytes()
                ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
                for k, b, e in zip(some.tolist(), [0, *ends], ends):
                    out[k] = ids[b:e]
        return out

    def cut(self, word: bytes) -> list[bytes | int]:
        """A word between ASCII white space as its pieces, and ids of special tokens."""
        if word.isalpha():  # ASCII letters only, no library needed
            return [word.lower()]
        if word[:-1].isalpha() and word[-1:] in MARKS:
            return [word[:-1].lower(), word[-1:]]
        out: list[bytes | int] = []
        text = word.decode("utf-8", "replace")
        for part in self.cut_special.split(text) if self.cut_special and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for letters, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    out.append(bytes(map(self.byte_of.__getitem__, letters)))
        return out

    def cuts(self, words: list[bytes]) -> list[list[bytes | int]]:
        """``cut`` of each word.  The library takes many in one call, joined by spaces,
        but for those that may hold a special token or white space beyond ASCII."""
        out: list[list[bytes | int]] = []
        joint: list[tuple[list[bytes | int], bytes, str]] = []
        for word in words:
            if word.isalpha():
                out.append([word.lower()])
            elif word[:-1].isalpha() and word[-1:] in MARKS:
                out.append([word[:-1].lower(), word[-1:]])
            elif b"<" in word or len((text := word.decode("utf-8", "replace")).split()) != 1:
                out.append(self.cut(word))
            else:
                out.append([])
                joint.append((out[-1], word, text))
        for a in range(0, len(joint), JOINT_WORDS):
            some = joint[a:a + JOINT_WORDS]
            text = self.normalizer.normalize_str(" ".join([t for _, _, t in some]))
            ends = [*itertools.accumulate([len(t) + 1 for t in text.split(" ")])]
            if len(ends) != len(some):
                for own, word, _ in some:
                    own += self.cut(word)
                continue
            place = 0
            for _, (start, end) in self.pre_tokenizer.pre_tokenize_str(text):
                while start >= ends[place]:
                    place += 1
                some[place][0].append(text[start:end].encode())
        return out

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words between ASCII white space, as 32-bit numbers."""
        cuts = self.cuts(words)
        distinct = [*{p for c in cuts for p in c if isinstance(p, bytes)}]
        known = dict(zip(distinct, self.pieces(distinct), strict=True))
        return [b"".join([known[p] if isinstance(p, bytes) else np.int32(p).tobytes() for p in c]) for c in cuts]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives without special tokens added."""
        return np.frombuffer(b"".join(self.words(text.encode().split())), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens, joined by spaces as the file names no decoder; unknown ids have none."""
        known = len(self.tokens)
        return " ".join(t for i in ids if 0 <= i < known and (t := self.tokens[i]) is not None)


class Memo:
    """Ids of words, kept from slice to slice.  When there are too many, those
    that the slice at hand doesn't use go."""

    def __init__(self, bpe: Bpe, most: int):
        self.bpe, self.most, self.known = bpe, most, {}

    def __call__(self, words: list[bytes]) -> Iterator[bytes]:
        distinct = set(words)
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known = {w: i for w in distinct if (i := self.known.get(w)) is not None}
        self.known.update(zip(new, self.bpe.words(new), strict=True))
        return map(self.known.__getitem__, words)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", keep: list[str] | None = None,
           tokenizers: str | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """``df`` with the ids of its whole texts as an array of 32-bit numbers.

    Defined results: a null text is empty and has no ids, like one of white
    space alone.  The strings of special tokens in a text become their ids.
    Repeated rows get equal ids; an empty table stays empty.  Columns named
    ``keep`` (all without it) pass through untouched, but for one named ``out``,
    which is replaced.  ``tokenizers``: folder of the vocabulary files, null for the
    installed ones.
    """
    through = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]

    def work():
        memo = Memo(Bpe(tokenizers), memo_words)

        def ids(texts: pa.Array) -> pa.Array:
            split = [text.split() for text in pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()]
            each = memo([*itertools.chain.from_iterable(split)])
            found = [b"".join(itertools.islice(each, len(words))) for words in split]
            ends = np.cumsum([0, *map(len, found)]) // 4
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["f0"])

        return ids

    return added(df, column(text_col).cast("string"), work, {out: "array<int>"}, through)


def decode(df: DataFrame, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None,
           tokenizers: str | None = None) -> DataFrame:
    """``df`` with the text of its ids: their tokens joined by spaces, special
    ones too.  Null arrays give the empty text; null ids and ids outside the
    vocabulary have no token.  Other columns as in ``encode``."""
    through = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]

    def work():
        bpe = Bpe(tokenizers)
        tokens = pa.array(bpe.tokens, pa.string())

        def texts(ids: pa.Array) -> pa.Array:
            flat = pc.list_flatten(ids)
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
            if flat.null_count or not pc.all(known, min_count=0).as_py():
                out = pa.array([bpe.decode([i for i in x or [] if i is not None]) for x in ids.to_pylist()], pa.string())
            else:
                ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()])
                out = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(flat)), " ")
            return pa.StructArray.from_arrays([out], names=["f0"])

        return texts

    return added(df, column(ids_col), work, {out: "string"}, through)


def op12_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    encoded = encode(table(spark, sf_dir, "documents"), keep=["doc_id"])
    both = decode(encoded)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
