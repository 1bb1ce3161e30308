"""Operator 4: base counts against brute force, bands by planted noise."""

import random
import re

from pulsegrid.llm import fertility as fe

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def texts():
    rng = random.Random(2)
    plain = "the of and house river walk green light under stone water paper small garden winter morning teacher".split()
    out = [None, "", " \n\t", "a", "a b c a b c", "x x x x", "é ü\nß\n\né ü\né ü ", "a\x0bb\x0cc\rd e f", "<a> | #$ &&"]
    for n in (49, 50, 80, 300):
        out += [" ".join(rng.choice(plain) for _ in range(n)), "\n".join(rng.choice(plain) for _ in range(n))]
    return out + ["word " * 60, " ".join(f"w{k}" for k in range(20_000))]


def test_base_counts(spark):
    rows = [(k, t, [None, "en", "zz"][k % 3], "clash") for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = fe.quality(df)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "fertility"]
    seen = got.select("doc_id", "text", "n_words", "fertility.*").collect()
    assert len(seen) == len(rows)
    for r in seen:
        assert r[2] == "clash"
        assert (r[3], r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text
        assert not (r.base_failed and r.kept) and r.kept is not None


def test_slices_do_not_change_figures():
    vocabularies = fe.Vocabularies(None, memo_words=3)
    data = [(t or "").encode() for t in texts()]
    whole = fe.measure(data, [None] * len(data), vocabularies, fe.BANDS, fe.SCRIPT_BANDS)
    for k, one in enumerate(data):
        alone = fe.measure([one], [None], vocabularies, fe.BANDS, fe.SCRIPT_BANDS)
        assert {c: v[0] for c, v in alone.items()} == {c: v[k] for c, v in whole.items()}


def test_fertility_figures_match_whole_text_tokens():
    vocabularies = fe.Vocabularies(None)
    text = "The quick brown fox jumps over the lazy dog while 日本 and ಕ stay"
    got = fe.measure([text.encode()], ["en"], vocabularies, fe.BANDS, fe.SCRIPT_BANDS)
    ids = vocabularies.pieces.encode(text)
    assert abs(got["chars_per_piece"][0] - len(text.replace(" ", "")) / len(ids)) < 1e-9
    assert abs(got["fallback_share"][0] - sum(vocabularies.is_byte[i] for i in ids) / len(ids)) < 1e-9


def test_learned_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(4)
    prose = ("the river runs past an old stone house where people walk in the morning light and talk about the weather while "
             "children play under tall trees near a bridge that was built long ago by workers from another town who came here "
             "looking for better land and water").split()
    rows = [(k, " ".join(rng.choice(prose) for _ in range(rng.randint(60, 90))), "en", True) for k in range(400)]
    noise = lambda: "".join(rng.choice("qxzjkvw0189") for _ in range(6))
    rows += [(1000 + k, " ".join(noise() for _ in range(70)), "en", False) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, fine boolean")
    got = fe.quality(df).select("fine", "fertility.base_failed", "fertility.kept").collect()
    assert all(r.kept for r in got if r.fine and not r.base_failed)
    assert not any(r.kept for r in got if not r.fine)


def test_empty_table(spark):
    assert fe.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_scripts():
    assert fe.script_of("hello wörld") == "latin"
    assert fe.script_of("привет") == "cyrillic"
    assert fe.script_of("日本語") == "cjk"
    assert fe.script_of("1234") == "other"


def test_poor_documents_of_small_groups_are_rejected(spark):
    rng = random.Random(5)
    prose = ("the river runs past an old stone house where people walk in the morning light and talk about the weather while "
             "children play under tall trees near a bridge that was built long ago by workers from another town who came here").split()
    noise = lambda: "".join(rng.choice("qxzjkvw0189") for _ in range(6))
    mixed = lambda n: " ".join(rng.choice(prose) if rng.random() < 0.6 else noise() for _ in range(n))
    rows = []
    for lang, n in (("en", 99), ("pl", 20)):
        rows += [(" ".join(rng.choice(prose) for _ in range(rng.randint(60, 300))), lang, True) for _ in range(n - 3)]
        rows += [(mixed(80), lang, False) for _ in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string, fine boolean")
    got = fe.quality(df).select("fine", "fertility.base_failed", "fertility.in_wide_band", "fertility.kept").collect()
    assert [r for r in got if r.fine and not r.base_failed and not r.kept] == []
    assert all(r.in_wide_band and not r.base_failed and not r.kept for r in got if not r.fine)


def test_text_without_letters_is_rejected():
    vocabularies, rng = fe.Vocabularies(None), random.Random(6)
    digits = " ".join(str(rng.randint(0, 10 ** 6)) for _ in range(80))
    thai = "ภาษาไทย เป็น ภาษา ที่ มี ระดับ เสียง ของ คำ แน่นอน และ ออกเสียง " * 8
    got = fe.measure([digits.encode(), thai.encode()], [None, None], vocabularies, fe.BANDS, fe.SCRIPT_BANDS)
    assert got["script"] == ["other", "other"] and got["in_wide_band"] == [False, True]


def test_no_size_changes_a_verdict():
    """Planted rows of one quality in classes of 1 to 400 documents: the fences
    move little by little, and the poor row is rejected in all."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(8)
    prose = ("the river runs past an old stone house where people walk in the morning light and talk about the weather while "
             "children play under tall trees near a bridge that was built long ago by workers from another town who came here").split()
    noise = lambda: "".join(rng.choice("qxzjkvw0189") for _ in range(6))
    fine = [" ".join(rng.choice(prose) for _ in range(70)) for _ in range(400)]
    poor = " ".join(rng.choice(prose) if rng.random() < 0.6 else noise() for _ in range(70))
    rows = [(text, "en", True) for text in fine]
    for n in (0, 5, 98, 99, 100):  # languages of n good documents and the poor one
        rows += [(text, f"x{n}", True) for text in fine[:n]] + [(poor, f"x{n}", False)]
    got = fe.quality(spark.createDataFrame(rows, "text string, lang string, fine boolean")).select("lang", "fine", "fertility.kept", "fertility.base_failed").collect()
    assert {r.lang for r in got if not r.fine and r.kept} <= {"x0"}  # the only one of its language and script has no one to differ from
    assert all(r.kept for r in got if r.fine and not r.base_failed)


def test_columns_of_any_name(spark):
    text = "the river runs past an old stone house where people walk in the morning light " * 5
    names = ["_lang", "_fences", "_0", "_1", "_group", "_class", "row", "figures", "at", "of", "lang_"]
    df = spark.createDataFrame([(1, text, "en", *names)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    got = fe.quality(df)
    assert got.columns == ["doc_id", "text", "lang", *names, "fertility"]
    assert tuple(got.first())[:-1] == (1, text, "en", *names)
    assert fe.with_fertility(df).columns == got.columns
