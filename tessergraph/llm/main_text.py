"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element is a line. With the markup go
script, style, what is hidden, reader comments, and the segments that tags name
as page furniture: menus, headers, footers, sidebars, notices, adverts and
forms, told by element, role, and the words of class and id, inside a line too.
A name is believed only of a part of the page: an element that holds most of
the page's text, and its article if there is one, isn't furniture, whatever it
is called.

Of what is left the distribution decides on every page. A line's length counts
without linked text, and lengths are summed over sliding windows of lines. Text
surges where the sums leave zero on the way to the threshold, and dives where
they are back at zero; stretches whose sums never reach the threshold are
dropped, and between surge and dive every line is kept. Where a page marks an
article, no window spans the article's edge, lines inside keep half of their
linked text, and lines outside have to be long to count, unless the article
holds little of the text. A linked first heading counts as text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import map_rows
from tessergraph.llm.markup import BLOCKS, CLOSES, RAW, UNSEEN, VOID, attributes, tokens

#: Lines of a window; the sum that makes a stretch text, at most, and as a share of the page's largest.
LINES, SURGE, SURGE_SHARE = 3, 80, 0.25
#: Beside a marked article, characters of a line that don't count; of the others every second one does.
OUTSIDE = 80
#: The share of the text outside of it under which a marked article doesn't make other lines count less.
LITTLE = 0.25
#: The share of a page's text from which an element isn't furniture.
MOST = 0.6

FURNITURE = frozenset("nav header footer aside form menu dialog button select input label head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Controls that stand apart from the words beside them.
CONTROLS = frozenset("button select input label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside share sharing social related recommended "
    "newsletter subscribe signup login popup modal overlay pagination pager widget toolbar skip hidden form search".split()
)
#: Words of a class that say where or what for, not what it holds: beside them a furniture word still names furniture.
PLACES = frozenset(
    "site page main global top bottom left right upper lower primary secondary inner outer wrap wrapper container box bar block slot area unit row col "
    "list item items link links button buttons icon icons post posts thread author user reader body count text message up to us module js is the of in".split()
)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def _named(names: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture, and whether comments: all words of it are furniture's and places."""
    furniture = comments = False
    for name in names.split():
        words = {w for w in _SPLIT.split(_CAMEL.sub(r"\1 \2", name).lower()) if w}
        if words & WORDS and words <= WORDS | PLACES:
            furniture, comments = True, comments or bool(words & COMMENT_WORDS)
    return furniture, comments


#: What an element is: text, furniture by its name, what is never text, reader comments.
TEXT, NAMED, UNREAD, COMMENTS = range(4)


def _kind(tag: str, source: str, inside: bool) -> int:
    """inside: it is within an article."""
    if tag in RAW or tag in UNSEEN:
        return UNREAD
    if not source or tag in ("html", "body", "main"):
        return NAMED if tag in FURNITURE else TEXT
    a = attributes(source)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return UNREAD
    furniture, comments = _named(f"{a.get('class', '')} {a.get('id', '')}")
    if comments:
        return COMMENTS
    if tag in FURNITURE or a.get("role", "").lower() in ROLES:
        return NAMED
    return NAMED if furniture and tag != "article" and not (inside and tag in HEADINGS) else TEXT


Line = tuple[str, int, bool]


def lines_of(page: str) -> list[Line]:
    """(text, characters in links, inside an article) of every block with text, without furniture."""
    read = list(tokens(page))
    lines, held, total, articles = _lines(read, frozenset())
    most = frozenset(e for e, (n, has) in held.items() if n >= MOST * total and (has or not articles)) if total else frozenset()
    return _lines(read, most)[0] if most else lines


def _lines(read: list[tuple[str, str, str]], believed: frozenset[int]) -> tuple[list[Line], dict[int, tuple[int, bool]], int, int]:
    """The lines; the text outside links that each element named as furniture holds, and whether it has an article; the page's text and number of articles.

    believed: elements that are text whatever their name.
    """
    out: list[Line] = []
    # tag, furniture, never text, article, link, number, text and articles before
    stack: list[tuple[str, bool, bool, bool, bool, int, int, int]] = [("", False, False, False, False, -1, 0, 0)]
    held: list[str] = []
    holds: dict[int, tuple[int, bool]] = {}
    linked, article, total, articles = 0, False, 0, 0

    def flush() -> None:
        nonlocal linked, article
        text = " ".join("".join(held).split())
        if text:
            out.append((text, min(linked, len(text)), article))
        held.clear()
        linked, article = 0, False

    def leave(first: int) -> None:
        for *_, number, before, seen in stack[first:]:
            if number >= 0:
                holds[number] = (total - before, articles > seen)
        del stack[first:]

    for number, (kind, value, source) in enumerate(read):
        _, furniture, unread, inside, link, *_ = stack[-1]
        if kind == "text":
            size = len(" ".join(value.split()))
            if not unread and not link:
                total += size
            if not furniture:
                held.append(value)
                if size:
                    article = article or inside
                    if link and stack[-1][0] != "h1" and not any(x[0] == "h1" for x in stack[-3:]):
                        linked += size
        elif kind == "open":
            if value in BLOCKS:
                flush()
                for closed in CLOSES.get(value, ()):
                    if stack[-1][0] == closed:
                        leave(len(stack) - 1)
                for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, and what is open inside of it
                    if stack[i][0] in BLOCKS:
                        if stack[i][0] == "p":
                            leave(i)
                        break
            elif value == "br" or value in CONTROLS:
                held.append(" ")
            if value in VOID:
                continue
            _, furniture, unread, inside, link, *_ = stack[-1]
            what = _kind(value, source, inside)
            if what == NAMED and number in believed:
                what = TEXT
            if value in HEADINGS and inside and stack[-1][0] == "header" and what == TEXT:
                furniture = any(x[1] for x in stack[:-1])  # the title in an article's own header
            furniture, unread = furniture or what != TEXT, unread or what in (UNREAD, COMMENTS)
            stack.append((value, furniture, unread, inside or value in ("article", "main") and not furniture, link or value == "a", number if what == NAMED else -1, total, articles))
            articles += value in ("article", "main") and not unread
        else:
            if value in BLOCKS:
                flush()
            elif value in CONTROLS:
                held.append(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == value:
                    leave(i)
                    break
    flush()
    leave(1)
    return out, holds, total, articles


def weights(lines: list[Line]) -> np.ndarray:
    """What each line counts for, by the lengths of its text and links."""
    size = np.array([len(text) for text, _, _ in lines], np.int64)
    linked = np.array([n for _, n, _ in lines], np.int64)
    inside = np.array([x for _, _, x in lines], bool)
    plain = size - linked
    marked = inside.any() and plain[inside].sum() >= LITTLE * plain[~inside].sum()
    return np.where(inside, size - linked // 2, np.maximum(0, plain - OUTSIDE) // 2 if marked else plain)


def surges(counts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which lines lie between a surge and its dive. edges: whether an article's edge is before the line."""
    at = np.arange(len(counts)) + LINES * np.cumsum(edges)  # empty lines at each edge, so that no window spans it
    spread = np.zeros(at[-1] + LINES, np.int64)
    spread[at] = counts
    total = np.concatenate(([0], np.cumsum(spread)))
    sums = total[LINES:] - total[:-LINES]
    threshold = min(SURGE, SURGE_SHARE * sums.max())
    alive = np.concatenate(([0], (sums > 0).astype(np.int8), [0]))
    between = np.zeros(len(spread), bool)
    for a, b in zip(np.flatnonzero(np.diff(alive) == 1), np.flatnonzero(np.diff(alive) == -1)):
        if sums[a:b].max() >= threshold:
            counted = np.flatnonzero(spread[a : b + LINES - 1])
            between[a + counted[0] : a + counted[-1] + 1] = True
    return between[at]


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    counts = weights(lines) if lines else np.zeros(0, np.int64)
    if not counts.any():
        return ""
    inside = np.array([x for _, _, x in lines], bool)
    kept = surges(counts, np.concatenate(([False], inside[1:] != inside[:-1])))
    return "\n".join(line[0] for line, k in zip(lines, kept) if k)


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns of every page, ``text`` and ``n_chars``.

    Null, empty and textless pages have an empty text. Each row is taken by
    itself, so repeated rows and ties don't matter; an empty table gives an
    empty one. Columns other than those named are left out, so names can't
    clash.
    """
    kinds = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def make():
        def one(batch):
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            return {f"k{i}": batch.column(i) for i in range(len(keep))} | {"text": texts}

        return one

    rows = map_rows(pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_column).alias("_html")), f"{kinds}, text string", make)
    return rows.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)}).withColumn("n_chars", F.length("text").cast("long"))
