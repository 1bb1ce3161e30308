"""Operator 12 against the tokenizers library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe()


TEXTS = [None, "", " \n\t", "a", "Hello  WORLD, it's 2024!", "naïve café — é ́x", "日本語のテキスト と ಕನ್ನಡ", "x<|endoftext|>y <|startoftext|>",
         "<|ENDOFTEXT|> <|endoftext|", "a b c\u0085d\x1ce", "ΣΑΣ ΟΔΟΣ İstanbul ǅ", "aaaa" * 50, "\x00\x01", "ßẞ ﬁ ﷺ", "👍🏽👩‍👩‍👧 I'LL they'Re"]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_texts_equal_the_library(spark, library):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz'0.é"
    texts = TEXTS + ["".join(rng.choice(letters + " ") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(k, t, "row", "value") for k, t in enumerate(texts)] + [(0, "a", "row", "again"), (None, "b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, value string")
    got = bpe.decode(bpe.encode(df))
    assert got.columns == ["doc_id", "text", "row", "value", "ids", "decoded"]
    seen = got.collect()
    assert sorted(map(str, (tuple(r)[:4] for r in seen))) == sorted(map(str, rows))
    for r in seen:
        assert (r.ids, r.decoded) == expected(library, r.text), r.text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    own, library = test_any_text_equals_the_library.both
    text = text.encode("utf-8", "ignore").decode()
    ids, back = expected(library, text)
    assert own.encode(text) == ids
    words = [w[:k] + end for w in text.encode().split() for k in (1, len(w)) for end in (b"", b".", b"'s", b"!x", b"E")]
    words = [w.decode("utf-8", "ignore") for w in words]
    for word in words:
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    assert own.decode(ids) == back


test_any_text_equals_the_library.both = (bpe.Bpe(), Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY)))


def test_tree_always_gives_the_leftmost_least():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 33):
        ranks = [rng.choice([None, 0, 1, 2, 3]) for _ in range(n)]
        tree = bpe.PairTree(ranks)
        for _ in range(40):
            known = [(r, k) for k, r in enumerate(ranks) if r is not None]
            assert tree.root() == (min(known) if known else None)
            k = rng.randrange(n)
            ranks[k] = rng.choice([None, 0, 1, 2, 3])
            tree.set(k, ranks[k])


def test_merges_equal_a_plain_scan(own):
    def plain(symbols):
        symbols = [*symbols]
        while True:
            known = [(own.rank[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in own.rank]
            if not known:
                return symbols
            rank, k = min(known)
            symbols[k:k + 2] = [own.made[rank]]

    rng = random.Random(3)
    for n in (1, 2, 3, 7, 40, 200):
        for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(letters) for _ in range(n))
            symbols = [own.ids[x] for x in word[:-1]] + [own.ids[word[-1] + "</w>"]]
            assert own.merged(symbols) == plain(symbols)
            assert np.frombuffer(own.pieces([word.encode()])[0], dtype=np.int32).tolist() == plain(symbols)


def test_words_merged_together_equal_words_alone(own):
    rng = random.Random(9)
    words = [bytes(rng.choice(b"etaoinshrdlu.\xc3\xa9") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 17, 33, 64, 65, 66, 130]))) for _ in range(800)]
    alone = [own.pieces([w])[0] for w in words]
    assert own.pieces(words) == alone


def test_very_long_word_and_small_memo(spark, library):
    rng = random.Random(4)
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(60_000))
    rows = [(1, long), (2, "one two three four " * 3), (3, "five six seven")]
    got = {r.doc_id: r.ids for r in bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), memo_words=2).collect()}
    assert got == {i: expected(library, t)[0] for i, t in rows}


def test_nulls_unknown_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0, None, 10 ** 8, -1, 49407])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(df).collect()} == {1: "", 2: "", 3: "! <|endoftext|>"}
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert bpe.encode(empty).columns == ["doc_id", "text", "ids"]
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_query_digests(spark, library, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.op12_segment_tree_bpe(spark, str(tmp_path)).collect():
        ids, back = expected(library, TEXTS[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(back))


def test_many_words_are_cut_like_each(own):
    """One call of the library for many words: white space beyond ASCII, marks that
    compose, special tokens and broken bytes stay in their word."""
    parts = ["a", "B", "'s", "é", "é", "́", " ", " ", "\x1c", "Σ", "漢", "½", "7", "<", "<|endoftext|>", "$", ";", "가"]
    words = [w for x in parts for y in parts for z in ("", "!", "É") for w in (x + y + z).encode().split()] + [b"\xff\xfe", b"a\xc3"]
    assert own.cuts(words * 4) == [own.cut(w) for w in words] * 4
    calls = []

    class Library:
        def pre_tokenize_str(self, text, library=own.pre_tokenizer):
            calls.append(text)
            return library.pre_tokenize_str(text)

    kept, own.pre_tokenizer = own.pre_tokenizer, Library()
    try:
        own.cuts(["straße7".encode()] * 1000)
    finally:
        own.pre_tokenizer = kept
    assert len(calls) == -(-1000 // bpe.JOINT_WORDS)
