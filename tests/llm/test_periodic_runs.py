"""Operator 13 against a scan of every lag."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import periodic_runs as pr


def brute(words):
    """{(start, length, period)} by every lag, smallest period per stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def own(texts):
    return pr._runs_of([" ".join(t).encode() for t in texts])


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def cases():
    rng = random.Random(7)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, fibonacci(600), list("ab" * 10 + "a") * 2, list("ab" * 30 + "a" + "ab" * 40)]
    out += [["a"] * 300 + ["b"] + ["a"] * 250, (["a"] * 40 + ["b"]) * 9 + ["a"] * 17, (list("abcab") * 20 + ["z"]) * 5]
    for letters in (1, 2, 3, 30):
        out += [[f"w{rng.randrange(letters)}" for _ in range(n)] for n in (13, 40, 200, 400)]
    for q in (1, 2, 5, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 127, 128, 200):
        for letters in (2, 1000):
            unit = [f"w{rng.randrange(letters)}" for _ in range(q)]
            for times in (2, 2.5, 6):
                text = (unit * 7)[:int(q * times)]
                out.append([f"x{rng.randrange(900)}" for _ in range(rng.randrange(40))] + text + [f"x{rng.randrange(900)}" for _ in range(20)])
                out.append(text + text[:-1] + text)
    for _ in range(40):  # short periods broken now and then, so that runs of runs arise
        block = [f"w{rng.randrange(2)}" for _ in range(rng.randrange(1, 4))] * rng.randrange(4, 40)
        for k in range(rng.randrange(3)):
            block[rng.randrange(len(block))] = "z"
        out.append((block + ["y"] * rng.randrange(2)) * rng.randrange(2, 5))
    return out


def test_all_runs_against_brute_force():
    texts = cases()
    runs, kept = own(texts)
    for text, got, left in zip(texts, runs, kept, strict=True):
        assert got == brute(text), text
        assert left.decode() == collapsed(text, got)


def test_texts_alone_and_together_agree():
    texts = cases()
    together = own(texts)
    for k, text in enumerate(texts):
        runs, kept = own([text])
        assert (runs[0], kept[0]) == (together[0][k], together[1][k])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), st.integers(1, 9)), max_size=6))
def test_random_repetitions(parts):
    text = [w for unit, times in parts for w in unit * times]
    assert own([text])[0][0] == brute(text)


def test_long_texts_stay_cheap():
    n = 60_000
    for text in (["a"] * n, ["a"] * (n // 2) + ["b"] + ["a"] * 200 + ["c"] + ["a"] * (n // 2), fibonacci(n)):
        runs, _ = own([text])
        assert runs[0]
    whole = [f"w{k}" for k in range(n // 3)] * 3
    assert own([whole])[0][0] == [(0, len(whole), n // 3)]


def query_row(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    start, length, period = top or (None, None, None)
    return (doc_id, len(runs), start, length, period, top and 1000 * length // period,
            sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(collapsed(words, runs)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, "a b " * 9, "x"), (None, None, "x"), (1, None, "x"), (2, "", "x"), (3, " \n\x0b", "x"), (3, "x " * 30, "x"), (3, "x " * 30, "x")]
    for i in range(150):
        n = rng.choice([1, 2, 5, 30, 200])
        rows.append((i - 40, rng.choice([" ", "\n", "\t \r"]).join(f"é{rng.randrange(rng.choice([2, 500]))}" for _ in range(n)), "x"))
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5
    spark.createDataFrame(rows, "doc_id long, text string, words string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.op13_minimizer_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(query_row(i, t)) for i, t, _ in rows)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a " * 14, "r", "v", "o", 5)], "id long, text string, row string, value string, out string, runs int")
    got = pr.with_runs(df, F.col("text"))
    assert got.columns == ["id", "text", "row", "value", "out", "runs", "collapsed"]
    row = got.collect()[0]
    assert tuple(row)[:5] == (1, "a " * 14, "r", "v", "o") and row.collapsed == "a"
    assert [tuple(x) for x in row.runs] == [(0, 14, 1)]
    assert pr.with_runs(df.limit(0), F.col("text")).count() == 0
    assert pr.find_runs(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)).shape == (0, 3)
