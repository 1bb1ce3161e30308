"""The pipeline's stages on a small table, each against what it must keep."""

import random

import corpus_pipeline
from pulsegrid.llm import fertility, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(8)
    words = "the river of stone and house in light to walk a paper garden winter teacher market is on for with by that was it as be at".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))
    rows = [(k, text(rng.randint(80, 200)), "en", f"s{k % 4}") for k in range(60)]
    near = rows[7][1].split()
    near[3] = "changed"
    rows += [(100, rows[5][1], "en", "s9"), (101, rows[5][1].replace(" ", "  "), None, None), (102, " ".join(near), "en", "s1")]
    rows += [(200, "too short", "en", "s0"), (201, None, None, None), (202, "rep eat it " * 60, "en", "s0"), (None, text(90), "en", "s2")]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in rows]


def test_stages(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        rows = [tuple(r) for r in kept.collect()]
        seen.append((kept.columns, rows))
        kept = spark.createDataFrame(rows, kept.schema)
    columns = docs.columns
    assert all(c == columns for c, _ in seen[:-1])
    ids = [{r[0] for r in rows} for _, rows in seen]
    verdict = {r.doc_id: r.kept for r in fertility.quality(docs).select("doc_id", "fertility.kept").collect()}
    assert ids[0] == {i for i, k in verdict.items() if k} and not ids[0] & {200, 201, 202}
    assert ids[0] - ids[1] == {100, 101} and ids[1] - ids[2] == {102} and 7 in ids[2] and None in ids[2]
    assert set(seen[3][1]) <= set(seen[2][1])
    pieces = seen[4][1]
    assert sorted(r[4] for r in pieces) and {r[0] for r in pieces} == ids[3]
    assert sum(r[2] for r in pieces) == sum(len(r[-1]) // 2 for r in pieces)


def test_run_reads_documents(spark, tmp):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp}/documents.parquet")
    assert corpus_pipeline.run(spark, tmp).columns[:3] == ["doc_id", "start", "length"]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert {i for i in left if i is not None} == {i for i, c in groups.items() if i is not None and i == c}


def test_near_copies_without_ids_go_too_and_names_never_clash(spark):
    text = documents()[7][1].split()
    near = [" ".join(text[:k] + ["changed"] + text[k + 1:]) for k in (3, 9)]
    rows = [(5, " ".join(text)), (None, near[0]), (None, near[1]), (None, "quite another text of a few words"), (None, None), (6, near[0] + " x")]
    rows = [(i, t, "en", "s", 0, "a", "b", "c") for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA + ", place string, fertility string, _tie string")
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4]]))
    assert corpus_pipeline.quality_rules(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0
