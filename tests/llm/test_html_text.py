"""Operator 8: planted pages with known main text."""

from pulsegrid.llm import html_text as ht

LINE = "The people of the town walked to the river and talked about the weather, which was not as good as it had been in the spring. " * 2
LINE = LINE.strip()


def page(body, lang="en"):
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>No</title><style>p{{}}</style></head><body>{body}</body></html>'


def test_article_without_its_surroundings():
    body = ('<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>'
            f'<article><h1>A &amp; B</h1><p>{LINE}<p>Short.</p><div class="ad">Buy now</div><p>x  &lt;b&gt;\n y&nbsp;z<br>w</p>'
            '<script>var t = "</p><p>no";</script><form><p>Mail <input> <button>Go</button></form>'
            '<section id="comments"><article><p>First! ' + LINE + '</p></article></section></article>'
            f'<aside><p>{LINE}</p></aside><footer>&copy; 2024 {LINE}</footer>')
    assert ht.main_text(page(body)) == f"A & B\n{LINE}\nShort.\nx <b> y z w"


def test_blocks_without_article_tags():
    body = (f'<div class="menu"><a href="/">Home</a></div><h2>Title</h2><p>{LINE}</p><p>So it was.</p><p>{LINE}</p>'
            '<ul><li><a href="/1">one other story</a></li><li><a href="/2">another story</a></li></ul><p>© Site</p>')
    assert ht.main_text(page(body)) == f"Title\n{LINE}\nSo it was.\n{LINE}"


def test_short_pages_and_broken_markup():
    assert ht.main_text("") == "" and ht.main_text("<<<>>>").strip("<>") == ""
    assert ht.main_text("just words") == "just words"
    assert ht.main_text("<article><p>a<b>c<p>d</article><!-- open <p>no") == "ac\nd"
    assert ht.main_text('<article><p title="a > b">x</p><p title="open>y</p></article>').startswith("x")
    assert ht.main_text("<article><!-- <p>no</p> --><h1>One</h1>two<div>three<span> four</span></div></article>") == "One\ntwo\nthree four"
    assert ht.main_text('<div class="page with-sidebar"><article><p>kept</p></article></div>') == "kept"
    assert ht.main_text("<article>a<br><br>b<br>c</article>") == "a\nb c"
    assert ht.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"


def test_nothing_inside_an_article_is_dropped_or_capped():
    words = "&#233;&eacute;\u00e9 %%% ### 123"
    long = " ".join(f"zq{k}" for k in range(30_000))
    body = "<article>" + "".join(f"<p>{x}</p>" for x in ("x", words, long, "y")) + "</article>"
    assert ht.main_text(page(body)) == f"x\nééé %%% ### 123\n{long}\ny"


def test_operator_edge_cases(spark):
    rows = [(1, "u", page(f"<article><p>{LINE}</p></article>"), "old"), (2, None, None, "old"), (3, "u", "", None), (None, "u", "<p>", None)]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, TEXT string")
    out = ht.with_main_text(df)
    assert out.columns == ["page_id", "url", "text"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "u", LINE)] * 2 + [(2, None, ""), (3, "u", ""), (None, "u", "")]))
    assert ht.with_main_text(df.limit(0)).count() == 0


def test_long_blocks_with_few_stop_words_are_text():
    names = "Kowalski Nowak Wiśniewski Wójcik Kowalczyk Kamiński Lewandowski Zieliński Szymański 12 34 56"
    polish = "Wczoraj wieczorem mieszkańcy miasta spotkali się nad rzeką, żeby porozmawiać o pogodzie oraz planach budowy nowego mostu. " * 2
    polish, nav = polish.strip(), '<div class="menu"><a href="/">Home</a></div>'
    assert ht.main_text(page(f"{nav}<p>{LINE}</p><p>{names}</p><p>{LINE}</p>{nav}")) == f"{LINE}\n{names}\n{LINE}"
    for lang in ("pl", "en", "de"):  # without a list, and with a wrong attribute
        assert ht.main_text(page(f"{nav}<h2>Most</h2><p>{polish}</p><p>{names}</p><p>{polish}</p>{nav}", lang)).split("\n")[-3:] == [polish, names, polish]
    assert ht.main_text(page(f"{nav}<p>{LINE}</p><p>{names}</p>{nav}", "fr")) == f"{LINE}\n{names}"


def test_links_in_an_article_take_no_text_away():
    linked, short = 'Read the <a href="/r">full report</a>.', ["So it was.", "Words 1 2 3.", "It ended."]
    items = "".join(f'<li><a href="/{k}">Reference {k}</a></li>' for k in range(3))
    body = f"<nav><a href='/'>Home</a></nav><article><p>{short[0]}</p><p>{linked}</p><p>{short[1]}</p><ul>{items}</ul><p>{short[2]}</p></article>"
    want = [short[0], "Read the full report.", short[1], "Reference 0", "Reference 1", "Reference 2", short[2]]
    assert ht.main_text(page(body)).split("\n") == want
    assert ht.main_text(page(f"<article><p>{linked}</p></article>")) == "Read the full report."
    assert ht.main_text(page(f'<article><p>{LINE}</p><div class="related"><a href="/">Other</a></div></article>')) == LINE


PARAGRAPH = "This is the kind of text that a reader came for, and it is as long as it has to be so that nobody will take it for a menu. " * 3
PARAGRAPH = PARAGRAPH.strip()


def test_words_in_names_take_no_article_away():
    text = f"<p>{PARAGRAPH}</p><p>So it was.</p>"
    want = f"{PARAGRAPH}\nSo it was."
    for body in (f'<div class="social-science">{text}</div>', f'<article class="public-notice">{text}</article>',
                 f'<main class="widget-page">{text}</main>', f'<article><div id="login-to-power-grid">{text}</div></article>',
                 f'<p title="a hidden gem">{PARAGRAPH}</p><p>So it was.</p>', f"<form action='/x'><input type=hidden><input type=hidden>{text}</form>",
                 f'<article><section class="related-work">{text}</section></article>', f'<article class="widget">{text}</article>'):
        assert ht.main_text(page(body)) == want, body


def test_every_boilerplate_word_as_part_of_a_name():
    for word in sorted(ht.BAD_WORDS):
        for name in (f"{word}-studies", f"history_of_{word}", f"{word}Essay"):
            assert ht.main_text(page(f'<div class="{name}"><p>{PARAGRAPH}</p></div>')) == PARAGRAPH, name
            assert ht.main_text(page(f'<article><div id="{name}"><p>{PARAGRAPH}</p><p>Yes.</p></div></article>')) == f"{PARAGRAPH}\nYes.", name
        # The name alone marks boilerplate beside a text, but a page is never emptied by it.
        both = f'<article><p>{LINE}</p><div class="{word}"><p>{PARAGRAPH}</p></div></article>'
        assert ht.main_text(page(both)) == LINE, word
        assert ht.main_text(page(f'<div class="{word}"><p>{PARAGRAPH}</p></div>')) == PARAGRAPH, word


def test_names_of_boilerplate_words_only():
    for name in ("ad", "ad-slot", "comment-list", "cookie_notice", "relatedPosts", "footer-links", "newsletter-signup", "sidebar-content"):
        assert ht.main_text(page(f'<article><p>{LINE}</p><div class="x {name}"><p>{PARAGRAPH}</p></div></article>')) == LINE, name


def test_forms_formulas_signs_and_hidden_elements():
    search = '<form><label>Search</label> <input> <button>Go</button></form>'
    assert ht.main_text(page(f"<article><p>{LINE}</p>{search}<p>End.</p></article>")) == f"{LINE}\nEnd."
    wrapped = f'<form><input type="hidden"><div class="menu"><a href="/">Home</a></div><article><p>{LINE}</p><p>End.</p></article><input></form>'
    assert ht.main_text(page(wrapped)) == f"{LINE}\nEnd."
    formula = "where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> holds."
    assert ht.main_text(page(f"<article><p>{LINE}</p><p>{formula}</p></article>")) == f"{LINE}\nwhere x=2 holds."
    assert ht.main_text(page(f"<p>© 1999 {PARAGRAPH}</p>")) == f"© 1999 {PARAGRAPH}"
    assert ht.main_text(page(f"<p>{LINE}</p><p>© 1999 Site</p>")) == LINE
    for how in ("hidden", 'hidden=""', 'aria-hidden="true"', 'style="color:red; display: none"', "style='visibility:hidden'"):
        assert ht.main_text(page(f"<article><p>{LINE}</p><div {how}><p>{PARAGRAPH}</p></div></article>")) == LINE, how
    assert ht.main_text(page("<article><p>a <span hidden>b</span>c</p><p><i hidden>d</i>e</p></article>")) == "a c\ne"
    for how in ('hidden="until-found"', 'alt="display:none"', 'title="hidden"', 'data-x="hidden" aria-hidden="false"'):
        assert ht.main_text(page(f"<article><p>{LINE}</p><div {how}><p>{PARAGRAPH}</p></div></article>")) == f"{LINE}\n{PARAGRAPH}", how


def test_teasers_marked_as_articles_are_not_the_page():
    teasers = "".join(f'<article><h3>Other story {k}</h3></article>' for k in range(3))
    assert ht.main_text(page(f"<div><h1>Title</h1><p>{LINE}</p><p>{PARAGRAPH}</p></div>{teasers}")).split("\n")[:3] == ["Title", LINE, PARAGRAPH]


def test_inheritance_label_by_label():
    """The second pass against a search outwards from each block."""
    import random

    rng = random.Random(1)
    for trial in range(400):
        article = trial % 2
        found = [ht.Block(article, False, heading=rng.random() < 0.2) for _ in range(rng.randrange(1, 12))]
        for b in found:
            b.label = rng.choice(["good", "bad", "near", "short", "short"])
        given = [b.label for b in found]
        ht._second_pass(found, "good")
        for k, block in enumerate(found):
            # In an article only text decides for others.
            decides = lambda x: x == "good" or (x == "bad" and not article)
            left = next((x for x in reversed(given[:k]) if decides(x)), None)
            right = next((x for x in given[k + 1:] if decides(x)), None)
            if given[k] in ("good", "bad"):
                want = given[k]
            elif left is None or right is None or left == right:
                want = left or right or "good"
            else:
                want = "good" if article or given[k] == "near" or (block.heading and right == "good") else "bad"
            assert block.label == want


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, page(f"<article><p>{LINE}</p></article>"), "a", "b", "c", "d")], "id long, html string, _html string, row string, value string, f0 string")
    got = ht.with_main_text(df)
    assert got.columns == ["id", "_html", "row", "value", "f0", "text"]
    assert tuple(got.first()) == (1, "a", "b", "c", "d", LINE)
