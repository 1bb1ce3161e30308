"""Operator 1: targets against brute force, cube invariants, totals near targets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "tiny", "empty"]
    rows = []
    for k in range(n):
        source = rng.choice(sources[:5] + ["b"] * 3)
        rows.append((k, " ".join("w" for _ in range(int(rng.lognormvariate(4, 1)) + 1)), source))
    rows += [(n, "one two", "tiny"), (n + 1, None, "empty"), (n + 2, " \n", "a"), (n + 3, "", "empty")]
    return rows + rows[:5] + [(None, "null id " * 5, "b")] * 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))


def test_mix_near_targets_and_reruns_agree(spark):
    rows = corpus()
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.times <= 3 and (r.size or not r.times)
        taken[r.source] += r.times * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(30, 0.03 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(df.repartition(3)).collect()
    show = lambda rs: sorted(str((r.doc_id, r.source, r.size, r.times)) for r in rs)
    assert show(got) == show(again)


def test_small_blocks_keep_totals(spark):
    rows = [(k, "w " * (k % 37 + 1), "a" if k % 3 else "b") for k in range(400)]
    units = mixing.mix(frame(spark, rows))
    default = {r.source: r.t for r in units.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("t")).collect()}
    rows_ = spark.createDataFrame([(0, 400, bytes([k % 256, k // 256]), k % 37 + 1, 0.4) for k in range(400)],
                                  "place long, n long, key binary, size long, chance double")
    drawn = mixing.draw(rows_, block=16).agg(F.sum(F.col("drawn") * F.col("size")), F.sum("drawn"), F.count("*")).first()
    assert abs(drawn[0] - 0.4 * sum(k % 37 + 1 for k in range(400))) <= 40 and abs(drawn[1] - 160) <= 3 and drawn[2] == 400
    assert set(default) == {"a", "b"}


def test_flight_keeps_words_and_documents():
    rng = np.random.default_rng(9)
    for n, chance in ((3, 0.5), (50, 0.3), (500, 0.77)):
        size = (rng.lognormal(4, 1.5, n).astype(int) + 1).tolist()
        p = mixing.flight([chance] * n, size, rng.random, False)
        assert np.dot(p, size) == pytest.approx(chance * sum(size)) and sum(p) == pytest.approx(chance * n)
        assert sum(0 < x < 1 for x in p) <= 2
    same = mixing.flight([0.5] * 10, [7] * 10, rng.random, True)
    assert sum(same) == 5


def test_flight_is_unbiased():
    rng = np.random.default_rng(4)
    size = [100, 40, 30, 20, 10, 5, 3, 2]
    mean = np.mean([mixing.flight([0.3] * 8, size, rng.random, True) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_mixed_rows_and_empty_table(spark):
    rows = corpus(80)
    df = frame(spark, rows)
    times = {}
    for r in mixing.mix(df).collect():
        k = (r.doc_id, r.source)
        times[k] = times.get(k, 0) + r.times
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: v for k, v in times.items() if v}
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed(frame(spark, [])).count() == 0
    assert {r.times for r in mixing.mix(frame(spark, [(1, None, None), (2, " ", "a")])).collect()} == {0}


def test_equal_rows_and_columns_of_any_name(spark):
    names = ["_key", "_copy", "_n", "key", "times", "row", "equal", "place", "first"]
    rows = [(k, "one two three", "a", *names) for k in range(60)] + [(7, "equal words here", "a", *names)] * 40
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame(rows, schema)
    got = mixing.mixed(df)
    assert got.columns == df.columns
    seen = [tuple(r) for r in got.collect()]
    assert {r[3:] for r in seen} == {tuple(names)}
    by = {r.doc_id: r.times for r in mixing.mix(df).groupBy("doc_id").agg(F.sum("times").alias("times")).collect()}
    assert sum(by.values()) == len(seen) > 0
    for doc_id, n in by.items():
        assert sum(r[0] == doc_id for r in seen) == n
