"""Web pages as trees of blocks: a forgiving reader of HTML that keeps what the article model looks at.

Nodes are block elements, and runs: stretches of text and inline elements between block boundaries. Tags
that may be left out are closed as browsers do (a block ends an open p, an item the item before it, cells
and rows likewise); an end tag without its start is ignored (but for </p>, which parts blocks), what is open at the end is closed there.
Scripts, styles, titles, templates and other elements without prose, and controls of forms, give no text.
Character references are decoded; a br is white space. The page is read once, from its start to its end.
"""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements by their part in a page.
_BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_MUTE = frozenset("button select option optgroup datalist template svg math canvas object audio video map".split())
_CONTROLS = frozenset("button select textarea input".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that a start tag ends if it is open, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

# What words in attributes tell of an element.
_WORDS = {
    "text": "article content contents post entry main body story text prose",
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs pagination pager tabs toc skip",
    "head": "header masthead topbar branding logo tagline",
    "foot": "footer foot copyright colophon legal",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending complementary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "note": "notice notices cookie cookies consent gdpr alert popup modal overlay paywall disclaimer",
    "form": "form search login signin signup register subscribe subscription newsletter",
    "talk": "comment comments commentlist disqus respond replies reply discussion feedback reader readers",
    "share": "share sharing social follow",
}
GROUPS = tuple(_WORDS)
_GROUP_OF = {w: 1 << k for k, g in enumerate(GROUPS) for w in _WORDS[g].split()}
HIDDEN = 1 << len(GROUPS)
RUN = ""


class Page:
    """Nodes in page order, by columns: tag (RUN for runs), parent, bits of attribute words, text of runs, characters in links, controls."""

    def __init__(self):
        self.tag, self.parent, self.bits, self.text, self.linked, self.controls = ["body"], [-1], [0], [None], [0], [0]

    def add(self, tag: str, parent: int, bits: int = 0) -> int:
        for column, value in zip((self.tag, self.parent, self.bits, self.text, self.linked, self.controls), (tag, parent, bits, [] if tag == RUN else None, 0, 0)):
            column.append(value)
        return len(self.tag) - 1


def _bits(attributes: str) -> int:
    found = HIDDEN if "h" in attributes and _HIDDEN.search(attributes) else 0
    for m in _ATTRIBUTE.finditer(attributes):
        for part in _PART.findall(m[2]):
            found |= _GROUP_OF.get(part.lower(), 0)
    return found


def read(html: str) -> Page:
    """The blocks of a page; texts of runs have single spaces."""
    page = Page()
    stack: list[tuple[str, int, int, bool]] = [("body", 0, 0, False)]  # (tag, its block, links open, mute)
    count: dict[str, int] = {}  # open elements by name
    run, at, end = -1, 0, len(html)

    def pop(to: int) -> None:
        nonlocal run
        for name, block, _, _ in stack[to:]:
            count[name] -= 1
            if name in _BLOCKS:
                run = -1
        del stack[to:]

    def told(text: str) -> None:
        nonlocal run
        _, block, links, mute = stack[-1]
        if mute or not text:
            return
        text = unescape(text) if "&" in text else text
        if run < 0:
            if text.isspace():
                return
            run = page.add(RUN, block)
        page.text[run].append(text)
        if links:
            page.linked[run] += len(text.strip())

    def start(name: str, attributes: str) -> None:
        nonlocal run
        _, block, links, mute = stack[-1]
        if name in _CONTROLS:
            page.controls[block] += 1
        if name in ("html", "head", "body") or (name in _VOID and name != "hr"):
            if name == "br" and run >= 0:
                page.text[run].append(" ")
            if name == "body":
                page.bits[0] |= _bits(attributes) & ~HIDDEN
            return
        if name in _BLOCKS:
            run = -1
            if count.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _BLOCKS:
                        if stack[k][0] == "p":
                            pop(k)
                        break
            ends, stops = _ENDS.get(name, (_HEADINGS if name in _HEADINGS else (), _BLOCKS))
            if any(count.get(x) for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        pop(k)
                        break
                    if stack[k][0] in stops:
                        break
            _, block, links, mute = stack[-1]
            if name == "hr":
                return
            stack.append((name, page.add(name, block, _bits(attributes)), links, mute))
        else:
            stack.append((name, block, links + (name == "a"), mute or name in _MUTE))
        count[name] = count.get(name, 0) + 1

    def finish(name: str) -> None:
        nonlocal run
        if not count.get(name):
            if name == "p":  # as an empty paragraph
                run = -1
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                pop(k)
                return
            if name not in _BLOCKS and stack[k][0] in _BLOCKS:
                return

    while at < end:
        found = _TOKEN.search(html, at)
        if found is None:
            told(html[at:])
            break
        told(html[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if found[1]:
            finish(name)
        elif name in _RAW:
            if name in _CONTROLS:
                page.controls[stack[-1][1]] += 1
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        else:
            start(name, found[3])
    page.text = [None if t is None else " ".join("".join(t).split()) for t in page.text]
    return page
