"""Licence scan by a positional rare-token index (operator 3).

The index maps each word of the licence templates to its postings (template,
position).  A file is scanned in four steps, in DataFrame operations only:

1. each template is looked up by its own words of highest inverse document
   frequency, whatever else the file holds: by the rarest word of its mandatory
   key phrases, which stands in every place that counts (a template without
   such a word by as many as a share of ``LEAST_SHARE`` can't do without);
2. a posting at position p of a word at position q of the file says that the
   template would start at q - p: postings are intersected by that start, as the
   share (weighted by inverse document frequency) of the template's words that
   stand at their places;
3. an alignment counts when the share is at least ``LEAST_SHARE`` and all
   mandatory key phrases of the template stand there word for word;
4. labels are the verified templates', the score is the best verified share.

Document frequencies are counted over all documents; the vocabulary is that of
the templates, so what reaches the driver is one count per template word.
Nothing of a file leaves its row, so hot words or files skew nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import column, lower_ascii, table

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_SHARE = 0.8


@dataclass(frozen=True)
class Template:
    """A notice: its words, and phrases of it that must stand word for word.
    ``base``: a key phrase that must stand as a whole, and is counted."""
    label: str
    text: str
    mandatory: tuple[str, ...]
    base: bool = False


# Key phrases with their labels, and wording of public licences.
TEMPLATES = (
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
                    "that the following conditions are met", ("redistribution and use", "conditions are met")),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted", ("permission to use", "is hereby granted")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                         "associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "without restriction")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("released-mit", "released under the mit license", ("released under the mit license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)
#: Words too common to be looked up; they still count in phrases.
COMMON = frozenset("0 2 3 a and any are for form in into is of or that the this to under use v with without".split())


def licence_words(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.text.split()} - COMMON)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def inverse_frequencies(df: DataFrame, text_col: str, templates: tuple[Template, ...]) -> dict[str, float]:
    """Of every licence word, over all rows; one row per word comes back."""
    words = licence_words(templates)
    found = F.array_distinct(F.filter(_tokens(F.col(text_col)), lambda w: w.isin(words)))
    # One pass: a null element counts the rows.
    rows = df.select(F.explode(F.concat(found, F.array(F.lit(None).cast("string")))).alias("word"))
    counts = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get(None, 0)
    return {w: 1 + math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}


def _anchors(template: Template, idf: dict[str, float]) -> dict[str, list[int]]:
    """Words, with their positions, one of which stands at its place in every
    alignment that counts: no place of the template is missed."""
    text = template.text.split()
    rarity = lambda p: (idf[text[p]], text[p], -p)
    places = sorted((p for p, w in enumerate(text) if w in idf), key=rarity, reverse=True)
    phrases = [(_place(text, m.split()), len(m.split())) for m in template.mandatory]
    needed = [p for p in places if template.base or any(a <= p < a + n for a, n in phrases)]
    chosen, weight = needed[:1], 0.0
    if not chosen:
        # What misses all of these has a smaller share.
        for p in places:
            chosen, weight = [*chosen, p], weight + idf[text[p]]
            if weight > (1 - LEAST_SHARE) * (1 + 1e-9) * sum(idf[text[q]] for q in places):
                break
    out: dict[str, list[int]] = {}
    for p in chosen:
        out.setdefault(text[p], []).append(p)
    return out


def _alignments(template: Template, idf: dict[str, float], words: Column, hits: Column) -> Column:
    """Verified alignments of the template: array of (start, share)."""
    text = template.text.split()
    postings: dict[str, list[int]] = {}
    for p, w in enumerate(text):
        if w in idf:
            postings.setdefault(w, []).append(p)
    lookups = _anchors(template, idf)
    anchors = F.filter(hits, lambda h: h["word"].isin(sorted(lookups)))
    table_ = F.create_map(*[x for w, at in sorted(lookups.items()) for x in (F.lit(w), F.array(*[F.lit(p) for p in at]))])
    starts = F.array_distinct(F.flatten(F.transform(
        anchors, lambda h: F.transform(F.element_at(table_, h["word"]), lambda p: h["pos"] - p))))
    stands = lambda start, p: F.coalesce(F.get(words, start + p) == text[p], F.lit(False))
    total = sum(idf[w] for w in text if w in idf)

    def share(start: Column) -> Column:
        out = F.lit(0.0)
        for w, at in sorted(postings.items()):
            for p in at:
                out = out + F.when(stands(start, p), idf[w] / total).otherwise(0.0)
        return F.least(out, F.lit(1.0))

    def verified(start: Column) -> Column:
        out = F.lit(True)
        for phrase in template.mandatory:
            first = _place(text, phrase.split())
            for p in range(first, first + len(phrase.split())):
                out = out & stands(start, p)
        return out

    # Key phrases first: few alignments get as far as the sum.
    return F.filter(F.transform(F.filter(starts, verified), lambda s: F.struct(s.alias("start"), share(s).alias("share"))),
                    lambda a: a["share"] >= (1 - 1e-9 if template.base else LEAST_SHARE))


def _spans(template: Template, alignments: Column) -> Column:
    return F.transform(alignments, lambda a: F.struct(
        F.lit(template.label).alias("label"), a["start"].cast("long").alias("start"),
        F.lit(len(template.text.split())).alias("words"), a["share"].alias("share"), F.lit(template.base).alias("base")))


def _place(text: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(text)) if text[k:k + len(phrase)] == phrase)


def scan(df: DataFrame, text_col: str = "text", out: str = "licence", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``df`` with a struct ``out``: n_words, n_base, first_word, last_word,
    base_labels, labels, score and ``spans`` (label, start, words, share) of all
    verified alignments.

    Defined results: a null or empty text has no words, no labels (the empty
    string), null positions and score 0.  Columns of ``df`` pass through, one
    already named ``out`` is replaced; repeated rows are scanned alike; an empty
    table stays empty.
    """
    idf = inverse_frequencies(df, text_col, templates)
    vocabulary = sorted({w for t in templates for w in _anchors(t, idf)})
    keep = [c for c in df.columns if c.lower() != out.lower()]
    # The caller's columns travel in one struct, so that none meets a name of this function.
    row = F.struct(*[column(c).alias(f"c{k}") for k, c in enumerate(keep)], F.lit(0).alias("none")).alias("row")
    step = df.select(row, _tokens(column(text_col)).alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words")), lambda i: F.get(F.col("words"), i).isin(vocabulary))
    step = step.select("row", "words", F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(F.col("words"), i).alias("word"))).alias("hits"))
    found = [_spans(t, _alignments(t, idf, F.col("words"), F.col("hits"))) for t in templates]
    # Without looked-up words there is nothing to align.
    spans = F.when(F.size("hits") > 0, F.concat(*found)).otherwise(F.slice(F.concat(*found), 1, 0))
    step = step.select("row", F.size("words").cast("long").alias("n"), spans.alias("spans"))
    step = step.select("row", "n", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    starts = F.transform("base", lambda s: s["start"])
    return step.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(keep)], F.struct(
        F.col("n").alias("n_words"), F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined("base").alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["words"].alias("words"),
                                                s["share"].alias("share"))).alias("spans")).alias(out))


def op3_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "licence.*").drop("spans")
