"""Operator 11 against all scores."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, every=50):
    sound = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        sound.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for a, (vec_id, vector, label) in enumerate(sound):
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(x * y for x, y in zip(vector, other)), i, same == label)
                  for b, (i, other, same) in enumerate(sound) if b != a]
        for score, positive, _ in sorted((r for r in scored if r[2]), key=key)[:5]:
            fit = sorted((r for r in scored if not r[2] and 50 * score <= 100 * r[0] <= 95 * score), key=key)[:3]
            out += [(vec_id, positive, k + 1, i, score, s) for k, (s, i, _) in enumerate(fit)]
    return sorted(map(str, out))


def vectors(n, dims, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    return [(k, (centres[k % 4] + spread * rng.normal(size=dims)).astype(np.float32).tolist(), k % 3, "x") for k in range(n)]


def mined(spark, rows, tmp_path, name="a"):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(str(tuple(r)) for r in hn.op11_segment_summaries(spark, f"{tmp_path}/{name}").collect())


def test_query_against_brute_force(spark, tmp_path):
    rows = vectors(400, 24, 1) + [
        (400, None, 1, "x"), (401, [1.0] * 24, None, "x"), (450, [float("nan")] * 24, 1, "x"), (500, [float("inf")] * 24, 1, "x"),
        (550, [None] * 24, 1, "x"), (None, [0.3] * 24, 1, "x"), (None, [0.3] * 24, 2, "x"), (600, [], 1, "x"), (650, [0.5], 1, "x"),
        (700, [0.1] * 40, 2, "x"), (-50, [0.2] * 24, 2, "x"), (-49, [-0.2] * 24, 2, "x")]
    rows += rows[:120:3]  # repeated rows, anchors among them
    rows += [(900 + k, [0.25] * 24, k % 3, "x") for k in range(60)]  # ties
    assert mined(spark, rows, tmp_path) == brute(rows)


def test_one_label_no_positive_and_empty(spark, tmp_path):
    same = [(k, v, 1, "x") for k, v, _, _ in vectors(60, 8, 2) if k % 7]
    assert mined(spark, same, tmp_path, "one") == brute(same) == []
    assert mined(spark, [], tmp_path, "none") == []
    lone = [(50, [1.0, 2.0], 5, "x"), (51, [1.0, 2.0], 6, "x")]
    assert mined(spark, lone, tmp_path, "lone") == []


def test_chunks_blocks_and_a_hot_label_agree(spark):
    rng = random.Random(3)
    rows = [(k, v, 1 if rng.random() < 0.6 else rng.randrange(10), "x") for k, v, _, _ in vectors(300, 16, 4, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    results = [sorted(map(str, hn.mine(df, F.col("vec_id") % 10 == 0, chunk=c, block=b).collect())) for c, b in ((8192, 2048), (7, 11))]
    assert results[0] == results[1] and results[0]


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(6)
    for scale in (1, 300, 1e6):
        x, y = (np.floor(scale * rng.normal(size=(40, 64))) for _ in range(2))
        a, b = (hn.Rows(*[np.zeros(40)] * 4, v) for v in (x, y))
        before = None
        for level in hn.LEVELS:
            size, means, deviations = a.summary[level]
            middle, reach = size * (means @ b.summary[level][1].T), deviations @ b.summary[level][2].T
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            assert (np.abs(x @ y.T - middle) <= reach + slack).all()
            assert before is None or (reach <= before + slack).all()
            before = reach
        stored = a.summary[4]
        parts = x.reshape(40, 4, 16)
        assert np.allclose(stored[1], parts.mean(axis=2))
        assert np.allclose(stored[2], np.sqrt(((parts - parts.mean(axis=2)[:, :, None]) ** 2).sum(axis=2)))


def test_large_components_stay_exact(spark, tmp_path):
    rows = [(k, [1e7 + k, -3e6 + 2 * k, 12.5], k % 2, "x") for k in range(100)]
    assert mined(spark, rows, tmp_path) == brute(rows)


def test_bounds_leave_few_pairs_to_score():
    """On clustered vectors most pairs fall before they are scored."""
    rows = vectors(2000, 64, 8, 0.3)
    x = np.array([np.floor(256 * np.array(v)) for _, v, _, _ in rows])
    n = len(x)
    whole = hn.Rows(np.arange(n), np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64), x)
    few = whole.part(0, 50)
    floor = np.sort(few.vectors @ whole.vectors.T, axis=1)[:, -5]
    size, means, deviations = few.summary[hn.LEVELS[-1]]
    left = size * (means @ whole.summary[8][1].T) + deviations @ whole.summary[8][2].T >= floor[:, None]
    assert left.mean() < 0.3
    i, j, score = hn._within(few, whole, np.ones((50, n), bool), floor, np.full(50, np.inf))
    assert (np.bincount(i) >= 5).all()
