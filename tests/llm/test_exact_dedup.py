"""Operator 10: edge cases; the whole table is held against its SQL elsewhere."""

import hashlib
import re

from pulsegrid.llm.exact_dedup import exact_dedup, exact_groups

DOCS = [
    (5, "a  b\nc", "x"), (2, "a b c", "y"), (9, "a\tb c", "z"), (7, "a b c ", "z"),  # the last keeps its end space
    (1, None, "x"), (3, "", "x"), (4, " ", "x"), (6, "\n\t", "x"),
    (8, "dup", "x"), (8, "dup", "x"), (8, "dup", "y"), (None, "null id", "x"), (None, "null id", "x"), (10, "null id", "x"),
    (None, "only null", "x"),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, marked = min(known, default=None), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not marked, hashlib.sha256(norm.encode()).hexdigest()))
            marked |= i == keep
    return out


def key(row):
    return tuple(str(x) for x in row)


def test_groups_match_brute_force(spark):
    got = [tuple(r) for r in exact_groups(frame(spark)).collect()]
    assert sorted(got, key=key) == sorted(brute(DOCS), key=key)


def test_kept_rows_are_one_per_group_with_all_columns(spark):
    df = frame(spark)
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in DOCS})
    assert set(rows) <= set(DOCS)
    assert (2, "a b c", "y") in rows and (10, "null id", "x") in rows and (8, "dup", "x") in rows
    assert sum(i == 8 for i, _, _ in rows) == 1


def test_empty_table_and_long_text(spark):
    assert exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup(frame(spark, [])).count() == 0
    long = "word " * 400_000
    rows = [(1, long, ""), (2, long.replace(" ", "  "), ""), (3, long + "x", "")]
    assert {(r.doc_id, r.keep_id) for r in exact_groups(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 3)}
