"""Quality rules by tokeniser fertility (operator 4).

Each word of a text is cut by public vocabularies (loaded, never trained).  Per
document this gives

* characters per token, for each vocabulary: text a vocabulary has no words
  for (noise, symbols, wrong encodings) falls apart into short tokens;
* byte-fallback share: tokens that stand for a single byte since the
  vocabulary has no piece for the character;
* token entropy in bits: a text that repeats a few tokens has little.

A document is rejected when it fails the base rules or when a figure leaves
its band.  There are two bands.  The *wide* one is a parameter, by language or,
for a language without one, by script.  The *learned* one comes from all
documents that pass the base rules, by language (script, where the language is
null) and size class: the far-out fences of the figure, ``FENCE`` interquartile
ranges beyond the quartiles.  A class's quartiles are drawn towards those of its
language, and these towards their script's, by n / (n + ``SHRINK``) for n documents; a
script keeps its own centre, and its spread is drawn towards that of all documents.
So every document meets a band, one formula holds at any size, and a class of 99
documents is judged as one of 100 is.  Quartiles come from exact counts of figures in
fixed bins, so reruns agree.

Words are cut one by one (a piece never spans white space), so each distinct
word of a batch is encoded once and all figures are array arithmetic over word
numbers.  Nothing is shuffled; memory is bounded by one batch slice and one
memo of at most ``MEMO_WORDS`` words per Python worker, which only saves time.
The counts behind the learned bands are aggregates of a bounded number of bins.
"""

from __future__ import annotations

import base64
import itertools
import os
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import column, staged, table

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.tiktoken"
MEMO_WORDS = 150_000
SLICE_BYTES = 1_000_000
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 3.5
#: Documents whose own quartiles weigh as much as those of the group above.
SHRINK = 30
#: The script of the languages that have bands of their own.
HOME_SCRIPT = "latin"
#: Size classes double from MIN_WORDS words on, up to this many; the figures of
#: short texts vary more.
SIZE_CLASSES = 6
#: Figures with a learned band: bin width, and whether an upper fence holds too.
FENCED = {"chars_per_piece": (0.002, True), "chars_per_byte_token": (0.002, True), "token_entropy": (0.01, False)}


@dataclass(frozen=True)
class Band:
    """Least and most characters per token under each vocabulary, most
    byte-fallback share, least token entropy in bits."""
    pieces: tuple[float, float]
    bytes: tuple[float, float]
    fallback: float
    entropy: float


#: Production bands.  Latin-script languages share the vocabularies' home
#: ground: running text gets about 2 to 5 characters a token, and 50 words of it
#: carry over 5 bits a token.
LATIN = Band(pieces=(1.55, 9.0), bytes=(1.55, 9.0), fallback=0.10, entropy=4.0)
BANDS: dict[str, Band] = {"en": LATIN, "de": LATIN, "fr": LATIN, "es": LATIN}
#: By script, for languages without bands and rows without a language.  Scripts
#: that the vocabularies cover badly fall apart into bytes even in good text.
SCRIPT_BANDS: dict[str, Band] = {
    "latin": LATIN,
    "greek": Band(pieces=(0.5, 6.0), bytes=(0.4, 6.0), fallback=0.60, entropy=3.5),
    "cyrillic": Band(pieces=(0.8, 6.0), bytes=(0.4, 6.0), fallback=0.50, entropy=3.5),
    "cjk": Band(pieces=(0.3, 4.0), bytes=(0.3, 4.0), fallback=0.90, entropy=3.0),
    "other": Band(pieces=(0.2, 9.0), bytes=(0.2, 9.0), fallback=1.0, entropy=2.5),
    # Of "other", what has no letter of any script: as strict as for text with a single Latin one.
    "none": LATIN,
}

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
        "chars_per_piece double, chars_per_byte_token double, fallback_share double, token_entropy double, " \
        "script string, base_failed boolean, in_wide_band boolean"


def script_of(word_text: str) -> str:
    """The script of most letters of ``word_text``; ``other`` without letters."""
    points = np.frombuffer(word_text.encode("utf-32-le"), dtype=np.uint32)
    counts = {
        "latin": np.count_nonzero(((points >= 0x41) & (points <= 0x5A)) | ((points >= 0x61) & (points <= 0x7A))
                                  | ((points >= 0xC0) & (points <= 0x24F))),
        "greek": np.count_nonzero((points >= 0x370) & (points <= 0x3FF)),
        "cyrillic": np.count_nonzero((points >= 0x400) & (points <= 0x52F)),
        "cjk": np.count_nonzero(((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x9FFF))
                                | ((points >= 0xAC00) & (points <= 0xD7A3))),
    }
    counts["other"] = 1 + np.count_nonzero(points > 0x24F) - counts["greek"] - counts["cyrillic"] - counts["cjk"]
    return max(counts, key=counts.__getitem__)


class Vocabularies:
    """Piece ids of words under the sub-word vocabulary, and token counts of
    words under the byte-level one."""

    def __init__(self, folder: str | None, memo_words: int = MEMO_WORDS):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        place = (lambda name: os.path.join(folder, name)) if folder else public_tokenizers.path
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=place(PIECES))
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        with open(place(BYTES), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Per word its number of byte-level tokens and its piece ids, as 32-bit numbers.
        self.memo: dict[bytes, bytes] = {}
        self.memo_words = memo_words

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids of all words one after the other, how many each word has,
        and how many byte-level tokens."""
        new = [w for w in words if w not in self.memo]
        texts = [w.decode("utf-8", "replace") for w in new]
        ids = self.pieces.encode(texts, num_threads=1) if texts else []
        fresh = {w: array("i", [len(self.bytes.encode_ordinary(" " + t)), *i]).tobytes()
                 for w, t, i in zip(new, texts, ids, strict=True)}
        found = [fresh.get(w) or self.memo[w] for w in words]
        if len(self.memo) + len(fresh) > self.memo_words:
            self.memo.clear()
        if len(fresh) <= self.memo_words:
            self.memo.update(fresh)
        flat = np.frombuffer(b"".join(found), dtype=np.int32).astype(np.int64)
        sizes = np.array([len(f) for f in found], dtype=np.int64) // 4
        heads = np.cumsum(sizes) - sizes
        return np.delete(flat, heads), sizes - 1, flat[heads]


def _per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _repeat_words(codes: np.ndarray, owner: np.ndarray, n_distinct: int, n: int) -> np.ndarray:
    """Per text, its words that lie in a 3-word window found at least twice in it."""
    if len(codes) < 3:
        return np.zeros(n)
    inside = owner[:-2] == owner[2:]
    pair = codes[:-2] * n_distinct + codes[1:-1]
    if n_distinct ** 3 * n >= 2 ** 62:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = np.unique(pair * n_distinct + codes[2:], return_inverse=True)[1].astype(np.int64) * n + owner[:-2]
    else:
        window = (pair * n_distinct + codes[2:]) * n + owner[:-2]
    _, inverse, counts = np.unique(np.where(inside, window, -1), return_inverse=True, return_counts=True)
    twice = inside & (counts[inverse] >= 2)
    covered = np.zeros(len(codes), dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return _per_text(covered, owner, n)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], langs: list[str | None], vocabularies: Vocabularies,
            bands: dict[str, Band], script_bands: dict[str, Band]) -> dict[str, list]:
    """The columns of STATS for whole texts in UTF-8."""
    n = len(texts)
    split = [t.split() for t in texts]  # on ASCII white space, as these are bytes
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in itertools.chain.from_iterable(split)), dtype=np.int64)
    n_words = np.array([len(s) for s in split], dtype=np.int64)
    owner = np.repeat(np.arange(n), n_words)
    words = list(number)
    chars = np.array([len(w.decode("utf-8", "replace")) for w in words], dtype=np.int64)
    flat, sizes, byte_tokens = vocabularies.of(words)
    starts = np.cumsum(sizes) - sizes
    fallback = np.bincount(np.repeat(np.arange(len(words)), sizes), weights=vocabularies.is_byte[flat], minlength=len(words))

    repeat = _repeat_words(codes, owner, max(1, len(words)), n)
    word_chars = _per_text(chars[codes], owner, n)
    tokens = _per_text(sizes[codes], owner, n)
    by_bytes = _per_text(byte_tokens[codes], owner, n)
    byte_pieces = _per_text(fallback[codes], owner, n)
    # Entropy: the pieces of every word of every text, counted per text.
    reps = sizes[codes]
    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(starts[codes], reps)
    seen, count = np.unique(np.repeat(owner, reps) * vocabularies.size + flat[at], return_counts=True)
    whose = seen // vocabularies.size
    share = count / tokens[whose]
    entropy = np.bincount(whose, weights=-share * np.log2(share), minlength=n)

    with np.errstate(divide="ignore", invalid="ignore"):
        per_piece = np.where(tokens > 0, word_chars / tokens, np.nan)
        per_byte = np.where(by_bytes > 0, word_chars / by_bytes, np.nan)
        fallback_share = np.where(tokens > 0, byte_pieces / tokens, np.nan)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    scripts, wide = [], []
    for k in range(n):
        known = langs[k] in bands
        text = "" if known else b"".join(split[k]).decode("utf-8", "replace")
        script = None if known else script_of(text)
        letterless = script == "other" and "none" in script_bands and not any(map(str.isalpha, text))
        band = bands[langs[k]] if known else script_bands["none" if letterless else script]
        scripts.append(script)
        wide.append(bool(band.pieces[0] <= per_piece[k] <= band.pieces[1]
                         and band.bytes[0] <= per_byte[k] <= band.bytes[1]
                         and fallback_share[k] <= band.fallback and entropy[k] >= band.entropy))
    figures = lambda x: [None if np.isnan(v) else float(v) for v in x]
    return {
        "n_words": n_words.tolist(), "word_chars": word_chars.astype(np.int64).tolist(),
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": repeat.astype(np.int64).tolist(),
        "chars_per_piece": figures(per_piece), "chars_per_byte_token": figures(per_byte),
        "fallback_share": figures(fallback_share), "token_entropy": figures(np.where(tokens > 0, entropy, np.nan)),
        "script": scripts, "base_failed": failed.tolist(), "in_wide_band": wide,
    }


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most ``limit`` bytes, a larger text alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def with_fertility(df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", out: str = "fertility",
                   bands: dict[str, Band] | None = None, script_bands: dict[str, Band] | None = None,
                   tokenizers: str | None = None, keep_text: bool = True) -> DataFrame:
    """``df`` (without its text if ``keep_text`` is false) with one struct column ``out`` of the fields of STATS.

    Defined results: a null text has no words; texts without words have null
    figures and fail the base rules.  A null or unknown language
    (or ``lang_col=None``) is judged by its script.  A column of ``df`` that is
    already named ``out`` is replaced; all others pass through untouched, also
    those named like a field of STATS.  Repeated rows are judged alike; an empty
    table stays empty.  ``tokenizers``: folder of the vocabulary files, null for
    the installed ones.
    """
    bands, script_bands = bands or BANDS, script_bands or SCRIPT_BANDS
    through = [c for c in df.columns if c.lower() not in (out.lower(), text_col.lower())]
    language = "lang"
    while language.lower() in {c.lower() for c in df.columns}:
        language += "_"
    ready = df.select(column(text_col).cast("string").alias(text_col),
                      (column(lang_col) if lang_col else F.lit(None)).cast("string").alias(language), *map(column, through))
    fields = T.StructType.fromDDL(STATS)
    given = [c for c in df.columns if c in through or (keep_text and c == text_col)]
    schema = T.StructType([ready.schema[c] for c in given]).add(out, fields)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(fields)
        vocabularies = None
        for batch in batches:
            vocabularies = vocabularies or Vocabularies(tokenizers)
            text, lang = batch.column(0), batch.column(1)
            for a, b in _slices(pc.fill_null(pc.binary_length(text), 0).to_pylist(), SLICE_BYTES):
                whole = pc.fill_null(text.slice(a, b - a).cast(pa.binary()), b"").to_pylist()
                got = measure(whole, lang.slice(a, b - a).to_pylist(), vocabularies, bands, script_bands)
                stats = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in kind], fields=list(kind))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in given), stats], names=[*given, out])

    return ready.mapInArrow(judged, schema)


def _band_keys(lang: Column, judged: Column) -> list[Column]:
    size = F.floor(F.log2(judged["n_words"] / MIN_WORDS))
    return [F.coalesce(lang.cast("string"), judged["script"]).alias("_group"),
            F.least(size, F.lit(SIZE_CLASSES - 1)).cast("int").alias("_class")]


def _drawn(own: str, above: str, n: str) -> Column:
    weight = F.col(n) / (F.col(n) + SHRINK)
    return weight * F.col(own) + (1 - weight) * F.col(above)


def learned_bands(judged: DataFrame, lang: Column, figures: Column, fence: float = FENCE) -> DataFrame:
    """Fences per group, size class and figure over all rows of ``judged`` that
    pass the base rules (``figures``: the struct of ``with_fertility``): columns
    _group, _class and a map from the figure to its (low, high)."""
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("figure"), F.floor(figures[name] / width).alias("bin")) for name, (width, _) in FENCED.items()]))
    counts = judged.where(~figures["base_failed"]) \
        .select(F.coalesce(figures["script"], F.lit(HOME_SCRIPT)).alias("_script"), *_band_keys(lang, figures), each.alias("f")) \
        .groupBy("_script", "_group", "_class", "f.figure", "f.bin").agg(F.count(F.lit(1)).alias("n"))
    # The same counts for every class, group, script and for all documents.
    none = {"_script": "string", "_group": "string", "_class": "int"}
    levels = [("_script", "_group", "_class"), ("_script", "_group"), ("_script",), ()]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[F.col(c) if c in own else F.lit(None).cast(t).alias(c)
                                                                  for c, t in none.items()]) for k, own in enumerate(levels)]))
    by = ["level", *none, "figure"]
    counts = counts.select(keys.alias("k"), "figure", "bin", "n").select("k.*", "figure", "bin", "n") \
                   .groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*by)
    ranked = counts.select("*", F.sum("n").over(own.orderBy("bin")).alias("upto"), F.sum("n").over(own).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin")))
    found = ranked.groupBy(*by).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.first("all").alias("n"))
    # A row per class and figure, whatever the number of documents.
    found = staged(found.select(*by, "n", ((F.col("q1") + F.col("q3")) / 2).alias("centre"),
                                (F.col("q3") - F.col("q1")).cast("double").alias("spread")).coalesce(1), "fertility-quartiles")

    def level(k: int, suffix: str) -> DataFrame:
        return found.where(F.col("level") == k).select(*levels[k], "figure", *[F.col(c).alias(c + suffix) for c in ("n", "centre", "spread")])

    classes = level(0, "0").join(level(1, "1"), ["_script", "_group", "figure"]).join(level(2, "2"), ["_script", "figure"]) \
                           .join(level(3, "3"), "figure")
    drawn = classes.withColumn("spread2", _drawn("spread2", "spread3", "n2"))
    for k in (1, 0):
        drawn = drawn.withColumns({f"{c}{k}": _drawn(f"{c}{k}", f"{c}{k + 1}", f"n{k}") for c in ("centre", "spread")})
    width = F.create_map(*[F.lit(x) for name, (w, _) in FENCED.items() for x in (name, w)])[F.col("figure")]
    upper = F.col("figure").isin([name for name, (_, both) in FENCED.items() if both])
    half = F.col("spread0") / 2 + fence * (F.col("spread0") + 1)
    # A language can have documents of several scripts; the most frequent one's fences hold.
    top = Window.partitionBy("_group", "_class", "figure").orderBy(F.desc("n0"), "_script")
    return drawn.withColumn("_place", F.row_number().over(top)).where("_place = 1") \
                .groupBy("_group", "_class").agg(F.map_from_entries(F.collect_list(F.struct(
                    "figure", F.struct(((F.col("centre0") - half) * width).alias("low"),
                                       F.when(upper, (F.col("centre0") + 1 + half) * width).alias("high"))))).alias("_fences"))


def quality(df: DataFrame, text_col: str = "text", lang_col: str = "lang", out: str = "fertility",
            keep_text: bool = True, **options) -> DataFrame:
    """``with_fertility`` with the verdict: the struct ``out`` gains ``kept``.
    The measured table is staged, as the learned bands need all of it first."""
    given = [c for c in df.columns if c.lower() != out.lower() and (keep_text or c.lower() != text_col.lower())]
    # The caller's columns travel in one struct, so that none meets a name of this function.
    row = F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(given)], F.lit(0).alias("none"))
    ready = df.select(row.alias("row"), column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"))
    judged = staged(with_fertility(ready, "text", "lang", "figures", keep_text=False, **options), "fertility")
    # A row for each language and size class: staged, so that the planner knows
    # its size and broadcasts it only if that is under the session's threshold.
    bands = staged(learned_bands(judged, F.col("lang"), F.col("figures")).coalesce(1), "fertility-bands")
    figures = F.col("figures")
    kept = ~figures["base_failed"] & figures["in_wide_band"]
    for name in FENCED:
        low, high = (F.col("_fences")[name][side] for side in ("low", "high"))
        kept = kept & F.coalesce(figures[name] >= low, F.lit(True)) & F.coalesce(figures[name] <= high, F.lit(True))
    group, size = _band_keys(F.col("lang"), figures)
    both = judged.withColumn("at", group).withColumn("of", size)
    met = both.join(bands, F.col("at").eqNullSafe(bands["_group"]) & F.col("of").eqNullSafe(bands["_class"]), "left")
    return met.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(given)], figures.withField("kept", kept).alias(out))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, fertility figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality(docs, keep_text=False).select("doc_id", "fertility.*")
