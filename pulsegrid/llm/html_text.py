"""Main text of web pages by two-pass block rules (operator 8).

A page is cut into blocks at block-level tags.  *First pass*, each block alone:
elements that hold no main text (navigation, footers, scripts, hidden ones and the
like), link density, length and stop words.  Long blocks with many stop words are
decided as text, link-dense ones as boilerplate; what is short or has few stop words
stays ambiguous.  On a page in a language without a stop-word list length alone decides.
*Second pass*: an ambiguous block inherits the label of its nearest decided
neighbours; where they differ, long blocks and headings above text count as
text.

Class and id names only help.  A name made of nothing but boilerplate words
(``ad``, ``comment-list``, ``cookie-notice``) marks boilerplate, but never the
page's own ``article`` or ``main``, and should a page be left without any text, the
long blocks under such marks are its text.  A name that merely contains such a word
(``social-science``, ``related-work``) only takes link-dense blocks away.  A form
is one if it has little text for its controls; a page wrapped in a form is a page.

Where a page marks its article (``article`` or ``main``), blocks outside it are
boilerplate, unless only these are text by the first pass.  Inside it links alone
leave a block ambiguous, neighbours only speak for blocks of the same article, and
without decided neighbours an ambiguous block there is text.  On a page without
any block decided as text, ambiguous blocks are the text.

Pages are independent: nothing is shuffled, and a task holds a few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import added, column, table

#: First-pass limits: characters, shares of a block's characters or words.
MAX_LINK_DENSITY, SHORT, LONG, MANY_STOPS = 0.2, 70, 200, 0.15

# Frequent function words by language.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its "
          "more no not of on one or she so than that the their there they this to was we were which who will with would you",
    "de": "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich "
          "im in ist kann mit nach nicht noch nur oder sich sie sind so über um und unter von vor war was wie wird wir zu zum zur",
    "fr": "a au aussi aux avec ce ces cette comme dans de des du elle en est et être il ils je la le les leur lui mais ne nous "
          "on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous y",
    "es": "a al como con cuando de del desde donde el ella en entre es esta este está fue ha hay la las le lo los más me muy no "
          "nos o para pero por que se ser si sin sobre son su sus también un una uno y ya",
}
# Elements of HTML by their part in the page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
DROPPED = {"nav", "footer", "aside", "button", "select", "template", "svg", "head", "object", "audio", "video",
           "canvas", "map", "menu", "dialog", "noscript", "datalist", "annotation", "annotation-xml"} | RAW
FORMS = {"form", "fieldset"}
CONTROLS = {"input", "textarea", "select", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "br"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the key closes an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
#: Words of class and id names that mark boilerplate.
BAD_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
             "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "menu",
             "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "related",
             "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
             "toolbar", "widget"}

#: Of these, the ones that hold articles of others, never the page's own.
OTHERS_WORDS = {"comment", "comments", "commentlist", "disqus", "related", "replies", "respond"}
#: Words that say nothing about what an element with such a name holds.
NEUTRAL_WORDS = {"area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content",
                 "contents", "form", "global", "group", "holder", "icon", "icons", "inner", "item", "items", "layer", "left", "link",
                 "links", "list", "message", "outer", "overlay", "pane", "panel", "posts", "right", "row", "section", "site", "slot",
                 "stories", "text", "title", "top", "unit", "wrap", "wrapper"}
#: Class names that begin so tell what a page has, not what the element is.
LAYOUT = ("has-", "with-", "no-", "is-")
#: Characters of text per control below which a form is a form, not a layout.
FORM_TEXT = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/][^\s"'=<>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]+)""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")
STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}


#: What a name says of its element.
NOTHING, HINT, MARK, OTHERS = range(4)


@dataclass
class Block:
    article: int
    gone: bool  # inside an element that holds no main text
    mark: int = NOTHING
    heading: bool = False
    form: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


@dataclass
class Element:
    name: str = ""
    gone: bool = False
    mark: int = NOTHING
    article: int = 0
    form: int = 0


def attributes(text: str) -> dict[str, str]:
    """Names in lower case and values, the first of a name."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _mark(given: dict[str, str]) -> int:
    """What class and id names say.  A name marks boilerplate only if all its
    words are of that kind or neutral."""
    found = NOTHING
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        if name.lower().startswith(LAYOUT):
            continue
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        bad = words & BAD_WORDS
        if bad and all(w in BAD_WORDS or w in NEUTRAL_WORDS or len(w) < 3 for w in words):
            found = max(found, OTHERS if bad & OTHERS_WORDS else MARK)
        elif bad:
            found = max(found, HINT)
    return found


def _hidden(given: dict[str, str]) -> bool:
    return ("hidden" in given and given["hidden"].lower() != "until-found") or given.get("aria-hidden", "").lower() == "true" \
        or bool(_NO_DISPLAY.search(given.get("style", "")))


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order."""
    out: list[Block] = []
    stack: list[Element] = []
    open_ = Counter()
    state = {"articles": 0, "breaks": 0}
    controls, forms = Counter(), 0  # of each form
    current: Block | None = None

    def end_block() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
        current = None

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        inside = stack[-1] if stack else Element()
        if current is not None and inside.gone != current.gone:
            if inside.gone:  # a hidden part of a line
                return
            end_block()
        if current is None:
            if text.isspace():
                return
            current = Block(inside.article, inside.gone, inside.mark, any(e.name in HEADINGS for e in stack[-4:]), inside.form)
        text = html.unescape(text)
        current.parts.append(text)
        if open_["a"]:
            current.linked += len("".join(text.split()))
        if not text.isspace():
            state["breaks"] = 0

    def close(at: int) -> None:
        for e in stack[at:]:
            open_[e.name] -= 1
        del stack[at:]

    def close_last(names: set[str], stop: set[str]) -> None:
        """Close the innermost open element of ``names`` unless one of ``stop`` lies inside it."""
        if not any(open_[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                close(k)
                return
            if stack[k].name in stop:
                return

    at = 0
    while (m := _TAG.search(page, at)):
        add(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, end, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name == "br":
            state["breaks"] += 1
            if state["breaks"] > 1:
                end_block()
            elif current is not None:
                current.parts.append(" ")
            continue
        inline = name in INLINE or name == "math" or open_["math"]
        if not inline:
            end_block()
            state["breaks"] = 0
        if end:
            if open_[name]:
                k = max(i for i, e in enumerate(stack) if e.name == name) if stack[-1].name != name else len(stack) - 1
                close(k)
            continue
        if not inline:
            close_last({"p"}, {"div", "section", "article", "main", "li", "td", "th", "body", "blockquote", "aside", "nav"})
        if name in CLOSES:
            close_last(CLOSES[name], {"ul", "ol", "dl", "table", "select"})
        if name == "body":
            close_last({"head"}, set())
        inside = stack[-1] if stack else Element()
        if name in CONTROLS and inside.form and not (name == "input" and attributes(attrs).get("type", "").lower() == "hidden"):
            controls[inside.form] += 1
        if name in VOID or attrs.endswith("/") and name not in RAW:
            continue
        given = attributes(attrs) if attrs else {}
        gone, mark, article, form = inside.gone, inside.mark, inside.article, inside.form
        own = _mark(given) if name not in ("html", "body") else NOTHING
        if name in ("article", "main") and not gone and mark < OTHERS and own < OTHERS and not article:
            state["articles"] += 1
            mark, article = NOTHING, state["articles"]
        else:
            mark = max(mark, own)
        if name in FORMS and not form:
            forms += 1
            form = forms
        # A header inside an article is its title; elsewhere it is the site's.
        gone = gone or name in DROPPED or (name == "header" and not article) or given.get("role", "").lower() in BAD_ROLES \
            or (name not in ("html", "body") and _hidden(given))
        stack.append(Element(name, gone, mark, article, form))
        open_[name] += 1
        if name in RAW:
            found = re.compile(f"</{name}\\b", re.I).search(page, at)
            at = found.start() if found else len(page)
    add(page[at:])
    end_block()
    # A form with much text for its controls is the layout of a page.
    size = Counter()
    for block in out:
        if not block.gone:
            size[block.form] += len(block.text)
    for block in out:
        if block.form and size[block.form] >= FORM_TEXT * controls[block.form]:
            block.form = 0
    return out


def _first_pass(block: Block, stops: list[frozenset[str]]) -> str:
    """good, bad, or ambiguous: near (not short, whatever its stop words) or short."""
    n = len(block.text)
    density = block.linked / max(1, len(block.text.replace(" ", "")))
    if block.gone or block.mark >= MARK or (block.form and n < LONG):
        return "bad"
    # In a marked article links alone don't make boilerplate, nor does a name with a hint.
    if density > MAX_LINK_DENSITY and (not block.article or block.mark):
        return "bad"
    if not block.article and n < LONG and ((n < SHORT and block.linked) or "©" in block.text):
        return "bad"
    if n >= LONG and _stop_share(block.text, stops) >= MANY_STOPS:
        return "good"
    return "short" if n < SHORT else "near"


def _stop_share(text: str, stops: list[frozenset[str]]) -> float:
    words = _LETTERS.findall(text.lower())
    return max(sum(w in s for w in words) for s in stops) / max(1, len(words)) if stops else 1.0


def _second_pass(found: list[Block], default: str) -> None:
    """Ambiguous blocks of ``found`` inherit from the nearest decided ones."""
    decided = [b.label if b.label in ("good", "bad") and not (b.article and b.label == "bad") else "" for b in found]
    before, after, last = [], [], ("", 0)
    for k, label in enumerate(decided):
        before.append(last)
        last = (label, k) if label else last
    last = ("", 0)
    for k in range(len(decided) - 1, -1, -1):
        after.append(last)
        last = (decided[k], k) if decided[k] else last
    after.reverse()
    for block, (a, _), (b, _) in zip(found, before, after):
        if block.label not in ("near", "short"):
            continue
        near = [x for x in (a, b) if x]
        if not near:
            label = default
        elif len(set(near)) == 1:
            label = near[0]
        else:
            label = "good" if block.article or block.label == "near" or (block.heading and b == "good") else "bad"
        block.label = label


def main_text(page: str) -> str:
    """The text blocks of a page, joined by line feeds; empty if there are none."""
    found = blocks(page)
    lang = _LANG.search(page)
    # The attribute may be wrong: any list may show that a block is text.
    stops = [] if lang and lang[1].lower() not in STOPS else list(STOPS.values())
    for block in found:
        block.label = _first_pass(block, stops)
    inside = [b for b in found if b.article and b.label != "bad"]
    outside = [b for b in found if not b.article and b.label == "good"]
    teasers = not any(b.label == "good" for b in inside) and sum(len(b.text) for b in outside) > sum(len(b.text) for b in inside)
    if inside and not teasers:
        for block in found:
            if not block.article:
                block.label = "bad"
        for article in {b.article for b in found} - {0}:
            _second_pass([b for b in found if b.article == article], "good")
    else:
        _second_pass(found, "good" if not any(b.label == "good" for b in found) else "bad")
        if not any(b.label == "good" for b in found):
            for block in found:
                if _first_pass(block, stops) in ("near", "short"):
                    block.label = "good"
    if not any(b.label == "good" for b in found):
        # Names have taken all: what is long and reads like text is the text.
        for block in found:
            bare = replace(block, mark=min(block.mark, HINT), form=0)
            if len(block.text) >= LONG and _first_pass(bare, stops) in ("good", "near"):
                block.label = "good"
    return "\n".join(b.text for b in found if b.label == "good")


def with_main_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``html_col`` and with the page's main text as ``out``.

    Defined results: a null, empty or unparsable page has the empty text.  A
    column already named ``out`` is replaced, all others pass through; repeated
    rows give equal texts; an empty table stays empty.
    """
    through = [c for c in df.columns if c.lower() not in (html_col.lower(), out.lower())]

    def work():
        def texts(pages: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array([main_text(x or "") for x in pages.to_pylist()], pa.string())], names=["f0"])

        return texts

    return added(df, column(html_col).cast("string"), work, {out: "string"}, through)


def op8_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
