"""Periodic run detection (operator 13).

A run is a stretch of words that repeats with its smallest period q, at least
twice and over at least ``LEAST`` words, and that no neighbouring word extends.
The method, by scale:

* *short periods*, up to ``DIRECT``: each lag is scanned, words against words;
* *scale k* (8, 16, 32, ...) finds the periods from 2k to 4k - 1.  Every window
  of k places elects the leftmost place whose k words have the least hash.  In a
  run of period q >= 2k the first window lies in the first period, and the
  window q places further has the same words, so it elects the place q further:
  two elected places with equal words at distance q.  Pairs of elected places
  with equal words and a distance of the scale thus seed every run, and each
  seed is extended in both directions by comparing words.

Places that repeat within k/2 form a chain, which lies in one run of small period.
Pairs inside a chain give that run only, found at its own scale; pairs of
two chains differ by few distinct lags, of which one pair each is extended.
So a text of one repeated word costs no more than prose.  Hashes only choose
seeds; words decide.

All texts of a batch slice are laid end to end, parted by numbers that equal
nothing.  Nothing is shuffled; memory is bounded by a slice or the longest text.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, added, column, table

LEAST = 12
#: Longest period that is scanned directly; the first scale starts above it.
DIRECT = 15
FIRST_SCALE = 8

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _doubled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of 2k words from those of k words."""
    return _mixed(hashes[:-k] * np.uint64(0xD6E8FEB86659FD93) + hashes[k:])


def _scan(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs with period ``lag`` (perhaps not the smallest)."""
    same = np.flatnonzero(words[lag:] == words[:-lag])
    if not len(same):
        return same, same
    breaks = np.flatnonzero(np.diff(same) != 1)
    first, last = same[np.r_[0, breaks + 1]], same[np.r_[breaks, len(same) - 1]]
    long = last + 1 - first + lag >= max(LEAST, 2 * lag)
    return first[long], last[long] + 1 + lag


def _elected(hashes: np.ndarray, k: int) -> np.ndarray:
    """Places of the least hash of every window of ``k`` places, the leftmost of
    equal ones: the place is the low end of what is compared."""
    if len(hashes) < k:
        return np.empty(0, dtype=np.int64)
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width < k:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places[np.r_[True, places[1:] != places[:-1]]]


def _seeds(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, lag) of equal words at lags of the scale."""
    low, high = 2 * k, 4 * k
    none = np.empty(0, dtype=np.int64)
    places = _elected(hashes, k)
    order = np.argsort(hashes[places], kind="stable")
    places, value = places[order], hashes[places[order]]
    near = (value[1:] == value[:-1]) & (places[1:] - places[:-1] < high)
    if not near.any():
        return none, none
    use = np.r_[near, False] | np.r_[False, near]
    places, value = places[use], value[use]
    # Chains: equal words at most k/2 places after the one before.
    gap = np.r_[0, np.diff(places)]
    head = np.r_[True, value[1:] != value[:-1]] | (gap > k // 2) | (gap < 0)
    at = np.flatnonzero(head)
    step = np.gcd.reduceat(np.where(head, 0, gap), at)
    first, last, value = places[at], places[np.r_[at[1:] - 1, len(places) - 1]], value[at]
    found = [], []
    for apart in itertools.count(1):
        if apart >= len(first):
            break
        one, two = slice(None, -apart), slice(apart, None)
        met = np.flatnonzero((value[one] == value[two]) & (first[two] - last[one] < high))
        if not len(met):
            break
        a, b = met, met + apart
        stride = np.gcd(step[a], step[b])
        least, most = first[b] - last[a], last[b] - first[a]
        by = np.maximum(stride, 1)
        start = least + np.maximum(0, -(-(low - least) // by)) * by
        count = np.where(stride > 0, (np.minimum(most, high - 1) - start) // by + 1, (least >= low).astype(np.int64))
        count = np.maximum(count, 0)
        which = np.repeat(np.arange(len(met)), count)
        lag = np.where(stride > 0, start, least)[which] + (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * by[which]
        # The pair of that lag whose second place is the smallest in its chain.
        back = np.minimum((last[a] - first[a])[which], lag - least[which]) // by[which] * by[which]
        found[0].append(last[a][which] - back)
        found[1].append(lag)
    return np.concatenate(found[0] or [none]), np.concatenate(found[1] or [none])


def _equal_for(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading numbers of ``a`` and ``b`` are equal."""
    most, at, block = min(len(a), len(b)), 0, 32
    while at < most:
        end = min(most, at + block)
        same = a[at:end] == b[at:end]
        if not same.all():
            return at + int(np.argmin(same))
        at, block = end, 2 * block
    return most


def _extended(words: np.ndarray, place: np.ndarray, lag: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, lag) of the stretches around the seeds, where long enough."""
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    out = []
    cuts = [0, *(np.flatnonzero(np.diff(lag)) + 1).tolist(), len(lag)]
    for a, b in itertools.pairwise(cuts):
        q, k = int(lag[a]) if a < b else 0, a
        while k < b:
            p = int(place[k])
            start = p - _equal_for(words[:p][::-1], words[:p + q][::-1])
            end = p + q + _equal_for(words[p:], words[p + q:])
            if end - start >= max(LEAST, 2 * q):
                out.append((start, end, q))
            # Seeds of this lag up to here lie in the same stretch.
            k = max(k + 1, a + int(np.searchsorted(place[a:b], end - q)))
    return out


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs of texts laid end to end: rows (start, end, period), in order.
    ``words``: numbers of the words, each text followed by a number found nowhere
    else; ``sizes``: words per text."""
    found = [np.empty((0, 3), dtype=np.int64)]
    for lag in range(1, min(DIRECT, int(sizes.max(initial=0)) // 2) + 1):
        start, end = _scan(words, lag)
        found.append(np.column_stack([start, end, np.full(len(start), lag)]))
    hashes, k, place = _mixed(words), 1, np.arange(len(words))
    while k < FIRST_SCALE and len(hashes) > k:
        hashes, k = _doubled(hashes, k), 2 * k
    while k >= FIRST_SCALE and len(hashes) > 2 * k:
        # Only texts of two periods of this scale can hold a run of it.
        able = sizes >= 4 * k
        if not able.any():
            break
        whole = np.repeat(able, sizes + 1)
        if whole.mean() < 0.7:
            hashes = np.append(hashes, np.zeros(len(words) - len(hashes), dtype=np.uint64))[whole]
            words, place, sizes = words[whole], place[whole], sizes[able]
            # What reaches beyond the last text is no seed, as its words differ.
        seeds, lags = _seeds(hashes, k)
        inside = seeds + lags < len(words)
        got = _extended(words, seeds[inside], lags[inside])
        if got:
            rows = np.array(got, dtype=np.int64)
            found.append(np.column_stack([place[rows[:, 0]], place[rows[:, 1] - 1] + 1, rows[:, 2]]))
        if len(hashes) <= k:
            break
        hashes, k = _doubled(hashes, k), 2 * k
    runs = np.concatenate(found)
    # A stretch found with several periods has the smallest.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _runs_of(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Per text its runs (start, length, period) and its kept words, joined."""
    split = [t.split() for t in texts]  # on ASCII white space, as these are bytes
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    flat = pa.array(itertools.chain.from_iterable(split), pa.large_binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(texts), dtype=np.int64)
    ends = starts + sizes
    is_word = np.ones(len(words), dtype=bool)
    is_word[ends] = False
    words[is_word], words[ends] = codes, -1 - np.arange(len(texts))
    found = find_runs(words, sizes)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    kept = [None] * len(texts)
    for k, (start, end, period) in zip((np.searchsorted(starts, found[:, 0], side="right") - 1).tolist(), found.tolist(), strict=True):
        runs[k].append((start - int(starts[k]), end - start, period))
    for k, own in enumerate(runs):
        if own:
            edges = np.zeros(len(split[k]) + 1, dtype=np.int64)
            spans = np.array(own, dtype=np.int64)
            np.add.at(edges, spans[:, 0] + spans[:, 2], 1)
            np.add.at(edges, spans[:, 0] + spans[:, 1], -1)
            dropped = np.cumsum(edges[:-1]) > 0
            kept[k] = b" ".join(itertools.compress(split[k], (~dropped).tolist()))
        else:
            kept[k] = b" ".join(split[k])
    return runs, kept


def with_runs(df: DataFrame, text: Column, runs: str = "runs", collapsed: str = "collapsed",
              keep: list[str] | None = None) -> DataFrame:
    """``df`` with the runs of ``text`` (by start, then period; starts are word
    numbers from 0) and its collapsed text: the words that no run repeats, joined
    by one space.

    Defined results: a null text has no words, no runs and the empty collapsed
    text, like one of white space alone.  Repeated rows are judged alike; an empty
    table stays empty.  Columns ``keep`` (all without it) pass through untouched,
    but for those named like an output, which are replaced.
    """
    through = [c for c in (df.columns if keep is None else keep) if c.lower() not in (runs.lower(), collapsed.lower())]

    def work():
        def found(texts: pa.Array) -> pa.Array:
            own, kept = _runs_of(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist())
            ends = np.cumsum([0, *map(len, own)])
            flat = np.array([r for x in own for r in x], dtype=np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs),
                                               pa.array(kept, pa.binary()).cast(pa.string())], names=["f0", "f1"])

        return found

    return added(df, text.cast("string"), work, {runs: RUNS, collapsed: "string"}, through)


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's test texts: with h the crc32 of the decimal id and g = h div
    10, a text whose h ends in 0 gets a period from word g mod n on; all other
    texts, and those of null ids, stay as they are."""
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(hashed / 10), F.size(words).cast("long")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((hashed % 10 == 0) & (n > 0),
                  F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a))).otherwise(text)


def op13_minimizer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document, as digests and the longest run."""
    docs = table(spark, sf_dir, "documents")
    found = with_runs(docs, planted(F.col("doc_id"), F.col("text")), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("top.length * 1000 div -top.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
