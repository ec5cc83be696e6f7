"""Leaf blocks of a page: runs of text between block-level tags, with their ancestors and hints.

A forgiving one-pass reader: comments, declarations, scripts, styles and other raw content are
skipped, unclosed elements are closed as browsers do, stray end tags are ignored, and a page cut off
anywhere is read to its end, however deep its elements lie. An element knows what is above it as
sets shared with its parent, so depth costs nothing per block; time and memory are linear in the page.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|aria-label|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

INLINE = frozenset("a abbr acronym b bdi bdo big blink br cite code data del dfn em font i img ins input kbd label map area mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
SKIPPED = frozenset("noscript template svg math select button object canvas audio video datalist".split())
#: Elements whose presence above a block tells something of it.
STRUCTURE = frozenset("article main nav header footer aside form section table ul ol dl figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 address details fieldset li td th p".split())
#: An open element of the first kind ends where one of the second kind begins, up to the boundary.
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

#: Word beginnings of class, id and role values, by what they hint at.
HINTS = {
    "ad": ("ad", "ads", "advert", "sponsor", "promo", "banner", "adsense", "outbrain", "taboola", "commercial", "affiliate"),
    "side": ("sidebar", "side", "widget", "rail", "complementary", "aside"),
    "comment": ("comment", "disqus", "reply", "replies", "respond", "discussion", "feedback", "reaction"),
    "foot": ("foot", "footer", "copyright", "contentinfo", "legal", "bottom", "colophon"),
    "head": ("header", "masthead", "banner", "topbar", "logo", "branding", "hero"),
    "nav": ("nav", "navigation", "menu", "breadcrumb", "pagination", "pager", "tabs", "toc", "skip", "links"),
    "share": ("share", "social", "follow", "facebook", "twitter", "tweet"),
    "notice": ("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "dialog", "overlay", "privacy", "warning", "toast"),
    "form": ("form", "search", "login", "signin", "signup", "register", "subscribe", "newsletter", "subscription", "contact"),
    "related": ("related", "recommend", "recommended", "more", "popular", "trending", "suggest", "latest", "readnext", "teaser", "similar", "similarposts"),
    "meta": ("meta", "byline", "author", "date", "tags", "tag", "category", "categories", "timestamp", "bio", "credit"),
    "body": ("article", "content", "post", "entry", "story", "body", "main", "text", "prose", "articlebody", "blog", "page"),
    "hidden": ("hidden", "hide", "invisible", "sr", "visually", "print"),
}
_HINT_OF = {w: k for k, ws in HINTS.items() for w in ws}


@dataclass(frozen=True)
class _Open:
    """An open element with what holds below it; its sets are shared with its parent where it adds nothing."""

    name: str
    tag: str
    above: frozenset[str]
    hints: frozenset[str]


_ROOT = _Open("", "", frozenset(), frozenset())


@dataclass
class Block:
    text: str
    tag: str
    above: frozenset[str]
    hints: frozenset[str]
    link_share: float


def _hints(attrs: str) -> frozenset[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                found.add("hidden")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.add("hidden")
        elif name != "aria-hidden":
            for w in _PARTS.findall(value):
                w = w.lower()
                if h := _HINT_OF.get(w) or _HINT_OF.get(w.rstrip("s")):
                    found.add(h)
    return frozenset(found)


def _first_above(at: list[int], low: int) -> int | None:
    """The lowest of some rising places that is above ``low``."""
    i = bisect.bisect_right(at, low)
    return at[i] if i < len(at) else None


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks that hold text, in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack elements of a name are
    solid: list[int] = []  # where in the stack block-level elements are
    text: list[str] = []
    linked = total = 0
    links = skipping = 0
    at = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                inner = stack[-1] if stack else _ROOT
                out.append(Block(words, inner.tag, inner.above, inner.hints, min(1.0, linked / max(1, total))))
            text.clear()
        linked = total = 0

    def pop(place: int) -> None:
        nonlocal links, skipping
        while len(stack) > place:
            name = stack.pop().name
            places[name].pop()
            if name not in INLINE:
                solid.pop()
            links -= name == "a"
            skipping -= name in SKIPPED

    while True:
        cut = page.find("<", at)
        if cut < 0:
            cut = len(page)
        m = _TAG.match(page, cut) if cut < len(page) else None
        if cut < len(page) and m is None:
            cut += 1  # a bare < is text
        if cut > at and not skipping:
            piece = page[at:cut]
            text.append(piece)
            n = len(piece)
            total += n
            linked += n * (links > 0)
        if m is None:
            at = cut
            if cut >= len(page):
                break
            continue
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["close"] or m["close2"]:
            if name not in INLINE:
                flush()
            if places[name]:
                pop(places[name][-1])
            continue
        if name == "br" or name == "hr":
            text.append(" ") if name == "br" and not skipping else flush()
            continue
        if name in RAW:
            if name not in INLINE:
                end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            flush()
            closes, bound = CLOSED_BY.get(name, ("", ()))
            targets = set(closes.split())
            if name in CLOSED_BY:  # up to the boundary every element of the kinds goes, with all inside it
                low = max((places[x][-1] for x in bound if places[x]), default=-1)
                first = min((i for x in (*targets, "p") if (i := _first_above(places[x], low)) is not None), default=None)
                if first is not None:
                    pop(first)
            elif solid and stack[solid[-1]].name == "p":
                pop(solid[-1])
        if name in VOID or attrs.endswith("/") and name in SKIPPED:
            continue
        outer = stack[-1] if stack else _ROOT
        hints = _hints(attrs) if attrs else frozenset()
        hints = outer.hints if hints <= outer.hints else outer.hints | hints
        if name in INLINE:
            stack.append(_Open(name, outer.tag, outer.above, hints))
        else:
            solid.append(len(stack))
            above = outer.above | {name} if name in STRUCTURE and name not in outer.above else outer.above
            stack.append(_Open(name, name, above, hints))
        places[name].append(len(stack) - 1)
        links += name == "a"
        skipping += name in SKIPPED
    flush()
    return out
