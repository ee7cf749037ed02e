"""A forgiving scanner for HTML as it is found: tags, comments, text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose content is markup, but no text of the page.
UNSEEN = frozenset("noscript template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", decoded, ""), ("open", tag, attributes) and ("close", tag, "") in page order.

    The content of RAW elements, comments and declarations are left out; a tag
    that the page's end cuts off is, too.
    """
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", html.unescape(page[at:]), ""
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()]), ""
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3]
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
        elif m[3].endswith("/") and tag not in VOID and tag in RAW:
            yield "close", tag, ""
