import random
from html.parser import HTMLParser

import pytest

from tessergraph.llm import main_text, queries

SF = "/root/testdata/sf0.001"

@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<script>var a='</p>';</script>", ""), ("plain words only", "plain words only"),
        ("<nav>Menu a b c</nav><article><h1>T &amp; U</h1><p><b>one\n two<br></b><p>three</p></article><footer>&copy; x</footer>", "T & U\none two\nthree"),
        ('<body><div class="ad">buy this now</div><article><p>short</p><aside>see also</aside><p>end</p></article>', "short\nend"),
        ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;x</p></article>", "a <b> &amp; é x"),
        ('<article><p>body</p><section id="comments"><article class="comment"><p>first!</p></article></section></article>', "body"),
        ('<div class="has-sidebar"><article><p>kept</p></article></div>', "kept"),
        ("<article><form><p>mail?</p></form><p>text</p><style>p{}</style></article><p class=notice>cut <a href=", "text"),
        ("<!-- <p>no</p> --><main><p>yes<ul><li>one<li>two</ul></main>", "yes\none\ntwo"),
        ('<p>' + "long text of a page without an article, " * 6 + '</p><p>more.</p><ul><li><a href="x">link one</a></li></ul>', ("long text of a page without an article, " * 6).strip() + "\nmore."),
    ],
)
def test_main_text(page, text):
    assert main_text.main_text(page) == text


def test_text_outside_an_article_is_kept_by_its_lengths():
    body = ["a long line of the main text, which no element marks, " * 3 for _ in range(4)]
    card = '<article><p>A teaser card</p></article><ul><li><a href="x">a link</a></li></ul>'
    page = f"<nav>menu</nav>{card}<div>{''.join(f'<p>{x}</p>' for x in body)}</div><footer>foot</footer>"
    assert main_text.main_text(page).split("\n") == [x.strip() for x in body]  # the card's lines don't surge beside them
    page = f"<p>a stray line</p><article>{''.join(f'<p>{x}</p>' for x in ['Title', *body, 'end'])}</article><p>another</p>"
    assert main_text.main_text(page).split("\n") == ["Title", *(x.strip() for x in body), "end"]


def test_pages_of_the_table(spark):
    rows = queries.op1_main_text(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>a</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.extract(df).collect()) == ["", "a"]
    assert main_text.extract(df.limit(0)).count() == 0



@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>Hello</p><button>Share</button>", "Hello"),
        ('<article><p>one <span class="advert">buy</span> two</p><p hidden>x</p><p>three <label>l</label></p></article>', "one two\nthree"),
        ('<article><h2 class="section-header">Head</h2><div class="search-algorithms"><p>on search</p></div></article>', "Head\non search"),
        ('<article><h2 class="notice">Head</h2><p>x <math><mi>y</mi></math> z<svg><text>no</text></p><p>more</p></article>', "Head\nx y z\nmore"),
        ('<article><header><h1>Title</h1><span>by me</span></header><p>a <span class="ad">b<p>c</article>', "Title\na\nc"),
        ('<div class="sidebar"><article><p>card</p></article></div><article><p>text</p></article>', "text"),
        ('<div class="sidebar"><p>all there is</p></div>', "all there is"),
        ('<div class="site-header">x</div><div class="relatedPosts">y</div><div class="comment-list"><p>z</p></div><p>text</p>', "text"),
        ("<object><p>inside</p></object><canvas>still</canvas><p>here", "inside\nstill\nhere"),
    ],
)
def test_furniture_is_told_by_the_segment(page, text):
    assert main_text.main_text(page) == text


LONG = "words of the main text, as long as they are in an article; " * 4
LINK = "<p><a href='x'>a linked line, as menus have them</a></p>"


@pytest.mark.parametrize(
    "page, text",
    [
        # without a mark: three title lines surge with the text, a line far from it doesn't, a link between is kept
        (f"<p>far away</p>{LINK * 3}<p>Kicker</p><p>Title</p><p>By me</p><p>{LONG}</p>{LINK}<p>{LONG}</p><p>end</p>{LINK * 3}<p>late</p>", ["Kicker", "Title", "By me", LONG, "a linked line, as menus have them", LONG, "end"]),
        # beside a mark: short lines are left out, long ones surge by themselves
        (f"<p>stray</p><article><p>Title</p><p>{LONG}</p></article><p>{LONG[:100]}</p>", ["Title", LONG]),
        (f"<article><p>Title</p><p>{LONG}</p></article>{LINK * 2}<p>{LONG}</p><p>{LONG}</p>", ["Title", LONG, LONG, LONG]),
        # a short marked card is not the text of a page whose text is elsewhere
        (f"<article><p>card</p></article><p>{LONG}</p><p>{LONG}</p>", [LONG, LONG]),
    ],
)
def test_windows_decide(page, text):
    assert main_text.main_text(page).split("\n") == [x.strip() for x in text]
    everything = [line[0] for line in main_text.lines_of(page)]
    assert everything != main_text.main_text(page).split("\n")


class Slow(HTMLParser):
    """Lines of well-formed pages by the library's parser."""

    def __init__(self):
        super().__init__()
        self.open, self.lines, self.now = [], [], []

    def end_line(self):
        text = " ".join("".join(t for t, _ in self.now).split())
        if text:
            self.lines.append((text, min(len(text), sum(len(" ".join(t.split())) for t, link in self.now if link)), "article" in self.open))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.end_line()
        self.open.append(tag + ("!" if ("class", "ad") in attrs else ""))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.end_line()
        self.open.pop()

    def handle_data(self, data):
        if not {"nav", "footer", "script", "div!"} & set(self.open):
            self.now.append((data, "a" in self.open))


def slow(page):
    parser = Slow()
    parser.feed(page)
    parser.end_line()
    sides = [sum(len(t) - n for t, n, x in parser.lines if x == side) for side in (True, False)]
    marked, rows = any(x for _, _, x in parser.lines) and sides[0] >= 0.25 * sides[1], []
    for i, (text, linked, inside) in enumerate(parser.lines):
        if i and inside != parser.lines[i - 1][2]:
            rows += [(None, 0)] * 3
        rows.append((text, len(text) - linked // 2 if inside else max(0, len(text) - linked - 80) // 2 if marked else len(text) - linked))
    sums = [sum(n for _, n in rows[i : i + 3]) for i in range(len(rows))]
    if not any(sums):
        return ""
    out, i = [], 0
    while i < len(rows):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(rows) and sums[j]:
            j += 1
        if max(sums[i:j]) >= min(80, 0.25 * max(sums)):
            stretch = rows[i : j + 2]
            while not stretch[0][1]:
                stretch = stretch[1:]
            while not stretch[-1][1]:
                stretch = stretch[:-1]
            out += [text for text, _ in stretch if text]
        i = j
    return "\n".join(out)


def crowded(page):
    """Whether an element that is named as furniture holds most of the page's text."""
    _, held, total, articles = main_text._lines(list(main_text.tokens(page)), frozenset())
    return any(n >= 0.6 * total and (has or not articles) for n, has in held.values())


def test_main_text_equals_a_slow_version():
    draw = random.Random(8)

    def line(most):
        words = " ".join(draw.choice(["some", "wörter", "&amp;", "of", "text,", "a &#233; b"]) for _ in range(draw.randint(1, most)))
        return draw.choice([words, words, f"<a href='x'>{words}</a>", f"{words} <b>bold</b>", f"<a href='y'>{words}</a> {words}"])

    def part(depth=0):
        kind = draw.choice(["p", "p", "p", "p", "ul", "nav", "ad", "div", "footer", "script"])
        if kind == "p":
            return f"<p>{line(draw.choice([3, 60]))}</p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{line(4)}</li>" for _ in range(draw.randint(1, 4))) + "</ul>"
        inner = "".join(part(depth + 1) for _ in range(draw.randint(0, 3))) if depth < 2 else ""
        if kind == "script":
            return "<script>var t = '<p>no</p>';</script>"
        return f'<div class="ad">{inner}</div>' if kind == "ad" else f"<{kind}>{inner}</{kind}>"

    pages = []
    for _ in range(1500):
        parts = [part() for _ in range(draw.randint(1, 12))]
        a = draw.randint(0, len(parts))
        b = draw.randint(a, len(parts))
        if draw.random() < 0.5:
            parts[a:b] = ["<article>", *parts[a:b], "</article>"]
        pages.append("<body>" + "".join(parts) + "</body>")
    changed = 0
    for page in pages:
        want = slow(page)
        if want and not crowded(page):  # an element that holds most of a page isn't furniture, which the slow version leaves out
            assert main_text.main_text(page) == want, page
            changed += [x[0] for x in main_text.lines_of(page)] != want.split("\n")
    assert changed > 300  # the windows left lines out


@pytest.mark.parametrize(
    "page, text",
    [
        # a frame that holds the page isn't furniture, whatever its name
        (f'<form id="aspnetForm"><nav>menu</nav><article><h1>T</h1><p>{LONG}</p></article><footer>foot</footer></form>', ["T", LONG]),
        (f'<header><div class="notice"><p>{LONG}</p><p>{LONG}</p></div></header><footer>foot</footer>', [LONG, LONG]),
        (f"<head><title>x</title><body><p>{LONG}</p>", [LONG]),
        # but beside an article it is, and comments and what is hidden always are
        (f"<article><p>T</p></article><footer>{LONG}</footer>", ["T"]),
        (f'<p>{LONG}</p><div class="comments">{f"<p>{LONG}</p>" * 9}</div><div hidden>{f"<p>{LONG}</p>" * 9}</div>', [LONG]),
        # an article of a word doesn't make short paragraphs beside it count less
        ("<article><p>One</p></article><div>" + "<p>a paragraph of the text that is not very long at all</p>" * 30 + "</div>", ["a paragraph of the text that is not very long at all"] * 30),
        # a linked first heading counts
        (f"<h1><a href='/x'>Linked title</a></h1><p>{LONG}</p>", ["Linked title", LONG]),
    ],
)
def test_no_name_is_a_veto(page, text):
    assert main_text.main_text(page).split("\n") == [x.strip() for x in text]


def test_very_long_pages():
    page = "<nav>" + "<a>m</a>" * 20_000 + "</nav><article>" + "".join(f"<p>{'word ' * 20}{i}</p>" for i in range(3000)) + "</article>"
    assert len(main_text.main_text(page).split("\n")) == 3000
    assert main_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
