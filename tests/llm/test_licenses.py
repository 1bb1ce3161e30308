"""Operator 3: places of key phrases against brute force, labels of notices."""

import re

from pulsegrid.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Software\"), to deal in the Software without restriction, including")
TEXTS = [
    None, "", "no notice here", "Released under the MIT License.", "mit-license MIT\nLICENSE mitlicense mit licenses xmit license",
    "mit license mit license", "Licensed under the Apache License, Version 2.0; apache license", "GNU General Public License, version 3",
    "general public licence general  public License general public", "license " * 300 + "mit", "GNU Lesser General Public License",
    "foo " * 500 + MIT, MIT.replace("obtaining", "getting"), MIT.replace("free of charge", "for a fee"),
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:", "émit license mit license é", "under the Mozilla public license. This Source Code Form is subject to the "
    "terms of the Mozilla Public License, v. 2.0.", "license mit", "MİT license",
]


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def scanned(spark, texts):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    out = li.scan(df)
    assert out.columns == ["doc_id", "text", "labels", "licence"]
    return {r.doc_id: r.licence for r in out.collect()}


def test_base_places_match_brute_force(spark):
    got = scanned(spark, TEXTS)
    for k, t in enumerate(TEXTS):
        g = got[k]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == brute(t), t
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_templates_are_aligned_and_verified(spark):
    got = scanned(spark, TEXTS)
    labels = {k: set(filter(None, g.labels.split(","))) for k, g in got.items()}
    assert labels[3] == {"mit", "released-mit"} and labels[6] == {"apache", "apache-2.0"} and labels[7] == {"gpl", "gpl-3.0"}
    assert "lgpl" in labels[10] and labels[11] == {"mit-text"} and labels[14] == {"bsd"} and "mpl-2.0" in labels[16]
    assert labels[12] == {"mit-text"} and got[12].score < 1  # one word differs, the key phrases stand
    assert labels[13] == set()  # a key phrase is missing
    assert [s.start for s in got[11].spans] == [500]
    assert labels[2] == set() and got[2].score == 0


def test_one_file_may_hold_every_template(spark):
    every = " lorem ipsum ".join(t.text for t in li.TEMPLATES)
    chance = "mozilla affero unencumbered redistribution creative lesser domain " * 3 + MIT
    got = scanned(spark, [every, chance] + TEXTS)
    assert got[0].labels.split(",") == sorted(t.label for t in li.TEMPLATES) and round(got[0].score, 9) == 1
    at = {(s.label, s.start) for s in got[0].spans}
    assert {(t.label, len(" lorem ipsum ".join(x.text for x in li.TEMPLATES[:k] + (li.Template("", "", ()),)).split()))
            for k, t in enumerate(li.TEMPLATES)} <= at
    assert got[1].labels == "mit-text" and round(got[1].score, 9) == 1


def test_templates_without_key_phrases(spark):
    free = (li.Template("free", "permission is hereby granted free of charge to any person", ()),)
    rows = [(0, "Permission is hereby granted, free of charge, to any person"), (1, "x permission is hereby given free of charge to any person"),
            (2, "granted person charge hereby")]
    got = {r.doc_id: r.licence for r in li.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=free).collect()}
    assert [got[k].labels for k in range(3)] == ["free", "free", ""] and round(got[0].score, 9) == 1 and 0.8 <= got[1].score < 0.9


def test_repeated_rows_and_empty_table(spark):
    assert len(set(map(str, scanned(spark, [TEXTS[3]] * 3).values()))) == 1
    assert li.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name(spark):
    names = ["_words", "_n", "_hits", "_spans", "_base", "words", "hits", "spans", "base", "row", "n"]
    text = "under the MIT license, as is"
    df = spark.createDataFrame([(1, text, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = li.scan(df)
    assert got.columns == ["doc_id", "text", *names, "licence"]
    row = got.first()
    assert tuple(row)[:-1] == (1, text, *names) and "mit" in row.licence.labels
