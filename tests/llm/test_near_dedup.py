"""Operator 6: links, components and estimates against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import near_dedup as nd


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    """component per id and sizes, over rows (id, text)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randint(1, 120))) for k in range(60)]
    base = text(150).split()
    for k in range(60, 120):  # a large group with chains, some members too far from all
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((k, " ".join(words)))
    rows += [(200, rows[70][1].upper()), (201, rows[70][1].replace(" ", "\n")), (202, rows[70][1])]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (304, "ONE two"), (305, "one two three")]
    rows += [(None, base and " ".join(base)), (400, rows[3][1]), (400, rows[3][1]), (401, rows[5][1]), (401, rows[7][1])]
    return rows


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 7)  # many blocks
    monkeypatch.setattr(nd, "CELL_BYTES", 3_000)  # many cells
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = [tuple(r) for r in nd.near_groups(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert len({c for _, _, c, _ in got}) < len(rows) - 40  # there is something to link


def test_empty_table(spark):
    assert nd.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (200, 200)]
    got = dict(tuple(r) for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100}


def test_estimate_is_collision_corrected(spark):
    rng = np.random.default_rng(3)
    factors, offsets = nd._functions(1, 1024)
    for share in (0.0, 0.5, 0.75, 1.0):
        both = rng.integers(0, 2 ** 63, int(2000 * share), dtype=np.uint64)
        rest = lambda: rng.integers(0, 2 ** 63, 2000 - len(both), dtype=np.uint64)  # noqa: B023, E731
        a, b = np.concatenate([both, rest()]), np.concatenate([both, rest()])
        true = len(both) / (4000 - len(both))
        for bits in (1, 2, 4, 8):
            x, y = (nd.pack(nd.minima(np.unique(s), factors, offsets), bits).view(np.int64).tolist() for s in (a, b))
            df = spark.createDataFrame([(x, y)], "a array<long>, b array<long>")
            assert abs(df.select(nd.estimate(F.col("a"), F.col("b"), 1024, bits)).first()[0] - true) < 0.12


def test_every_text_of_an_id_is_compared():
    """An id with two texts of one component: only its second one is near."""
    import pandas as pd

    vocabulary = [f"w{k}" for k in range(300)]
    far, near = " ".join(vocabulary[:100]), " ".join(vocabulary[100:200])
    other = near.replace("w150", "z")
    factors, offsets = nd._functions(nd.SEED, nd.ROWS * nd.BANDS)

    def row(left, doc, component, text):
        own = nd.shingles(text.encode(), nd._WordHashes())
        return (1, left, doc, component, nd.pack(nd.minima(own, factors, offsets), nd.BITS).view(np.int64), len(own), text)

    rows = [row(True, 7, 7, far), row(True, 7, 7, near), row(False, 9, 9, other)]
    columns = ["main", "left", "doc_id", "component", "packed", "n_shingles", "text"]
    for order in (rows, rows[::-1]):
        got = nd._block_links(pd.DataFrame(order, columns=columns), 0.55, nd.ROWS * nd.BANDS, nd.BITS, nd.PERCENT, nd.SHINGLE)
        assert got == [(7, 9)]


def test_sizes_that_cannot_link_are_not_compared(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:n])) for k, n in enumerate((400, 299, 302, 100, 74, 76, 303))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, nd.near_groups(df).collect()))) == sorted(map(str, brute(rows)))
