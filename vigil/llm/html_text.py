"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Lines in a sliding block, and the share of the page's greatest block sum at which text surges.
BLOCK_LINES, SURGE_SHARE = 5, 0.05
#: Characters of a line that count, and of a block of lines named like noise that is text where a page has no other.
LINE_CHARS, NAMED_LEAST = 200, 250

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_HINTS = re.compile(r"""\b(id|class|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = set("nav header footer aside form button select dialog menu head object svg canvas audio video map".split())
_BLOCK = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_MAIN = {"article", "main"}
_CLOSED_BY = {"p": _BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Names of noise, and words that only say which part of it a block is. A class or id is a name of noise if all its words
#: are among these and one is a name: "share-bar" is, "share-price-table" isn't.
_NAMES = set("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promoted promotion banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars cta opinions feedback guestbook discussion widget widgets footer masthead topbar cookie cookies consent notice notices gdpr newsletter newsletters subscribe subscription signup popup popups modal overlay share sharing social related recommended recommendation recommendations comment comments commentlist disqus respond reply replies pagination pager copyright disclaimer toolbar login".split())
_PARTS = set("area article articles author avatar bar block body bottom box btn button buttons card cards col column container content count date desktop even first footer form google group header heading holder icon icons id inner item items js last layout left legal like link links list main media message meta mobile module more name news odd outer page panel policy popular post posts primary privacy reader reading right row secondary section side site skip slot small stories story tab text thread title tools top unit up user wrap wrapper".split())
#: Names that inside an article tell of noise only if the block holds links or articles of its own: they are words of texts as well.
_WEAK = set("nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar notice notices share sharing social related recommended recommendation recommendations copyright disclaimer toolbar login opinions feedback discussion".split())
#: Names of readers' comments, which never wrap the page's own text; the singular ones may stand at an article of their own.
_COMMENTS, _COMMENT = set("comment comments commentlist disqus respond reply replies opinions guestbook discussion".split()), {"comment", "reply"}
#: Class words that say what a block has or how it stands, not what it is.
_QUALIFIER = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|with|without|no|not)[_-]+\S*|\S+[_-](?:open|opened|closed|fixed|enabled|disabled)(?!\S)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOISE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Noise:
    """An element taken as noise, and the one around it: hard by its kind, or soft by its name alone. Soft ones may wrap what the page is about."""

    __slots__ = ("hard", "holds", "outer", "weak", "wraps")

    def __init__(self, hard: bool, wraps: bool, outer: _Noise | None, weak: bool = False):
        self.hard, self.wraps, self.holds, self.outer, self.weak = hard, wraps, False, outer, weak


PLAIN, WRAPPED, SOFT, HARD = 0, 1, 2, 3


def _level(noise: _Noise | None) -> int:
    """PLAIN outside noise and in weakly named blocks of an article without links, WRAPPED if every noise around holds an article, main or h1 element, HARD if one is noise by its kind."""
    out = PLAIN
    while noise:
        if noise.hard:
            return HARD
        out, noise = out if noise.weak else max(out, WRAPPED if noise.holds else SOFT), noise.outer
    return out


def _named_noise(attributes: str, names: set[str] = _NAMES) -> bool:
    """Whether a class or id is a name of noise, word by word."""
    for name, value in _HINTS.findall(attributes):
        if name.lower() in ("id", "class"):
            for token in _QUALIFIER.sub(" ", value.strip("\"'")).split():
                own = [w.lower() for w in _WORD.findall(token)]
                if any(w in names for w in own) and all(w in _NAMES or w in _PARTS for w in own):
                    return True
    return False


def _noise_of(tag: str, attributes: str) -> str:
    """What makes an element noise: "" if nothing, "name" for its class or id (or a form, which may be around a whole page), "comment" for the name of a reader's comment, "kind" for all else.

    An article or main element is noise by name only where it is a reader's comment."""
    if tag in _DROPPED and tag != "form":
        return "kind"
    if not attributes.strip() or tag in {"html", "body"}:
        return "name" if tag == "form" else ""
    for name, value in _HINTS.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)) or (name == "role" and value.lower() in _NOISE_ROLE and tag not in _MAIN):
            return "kind"
    if tag in _MAIN:
        return "comment" if _named_noise(attributes, _COMMENT) else ""
    if _named_noise(attributes, _COMMENTS):
        return "comment"
    return "name" if tag == "form" or _named_noise(attributes) else ""


class Line(NamedTuple):
    """A block of text, its characters in links, its level of noise, whether it is in an article or main element, and in an h1."""

    text: str
    linked: int
    level: int
    main: bool
    head: bool


def lines_of(page: str) -> list[Line]:
    """The blocks of text of a page in their order.

    Scripts, styles and comments go; an end tag closes the elements opened since its start tag, and is
    ignored without one. Unclosed elements end with the page."""
    out: list[tuple[str, int, _Noise | None, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, _Noise | None, bool, bool]] = []  # tag, noise, main, link
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join(html.unescape("".join(parts)).split())):
            out.append((text, linked, stack[-1][1] if stack else None, bool(stack and stack[-1][2]), any(x[0] == "h1" for x in stack)))
        parts.clear()
        linked = 0

    def strengthen(noise: _Noise | None) -> None:
        while noise:
            noise.weak, noise = False, noise.outer

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack and stack[-1][3]:
                linked += len(text.strip())
                strengthen(stack[-1][1])

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(s[1] is not stack[i][1] for s in stack[i:]) or (i and stack[i - 1][1] is not stack[-1][1]) or stack[-1][2] != (i > 0 and stack[i - 1][2]):
                        flush()
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _VOID:
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        top = stack[-1] if stack else ("", None, False, False)
        if tag in _MAIN:
            strengthen(top[1])
        noise, kind = top[1], _noise_of(tag, m[3])
        if kind and not (tag == "header" and top[2]):
            flush()
            # Inside an article that is no noise itself, articles are comments and cards: nothing there wraps the page's own.
            weak = kind != "kind" and top[2] and tag != "form" and not _named_noise(m[3], _NAMES - _WEAK)
            noise = _Noise(kind == "kind", kind == "name" and not (top[2] and any(x[0] == "article" and x[1] is None for x in stack)), top[1], weak)
        elif noise and tag in _MAIN and _named_noise(m[3]):
            noise = _Noise(False, False, noise)
        elif noise and (tag in _MAIN or tag == "h1"):
            while noise and noise.wraps:
                noise.holds, noise = True, noise.outer
            noise = top[1]
        if not m[3].endswith("/") or tag in _BLOCK:
            stack.append((tag, noise, top[2] or tag in _MAIN, top[3] or tag == "a"))
    flush()
    return [Line(text, linked, _level(noise), main, head) for text, linked, noise, main, head in out]


def block_sums(weights: np.ndarray) -> np.ndarray:
    """Sums over each BLOCK_LINES successive lines; the first block ends with the first line, the last begins with the last."""
    return np.convolve(weights, np.ones(BLOCK_LINES))


def surging(weights: np.ndarray, sums: np.ndarray, least: float) -> np.ndarray:
    """Which lines stand between surge and dive: text surges with the first block whose sum reaches least and dives behind the last
    of successive such blocks. So a line is text if one block that holds it reaches least; lines without weight at both ends are lost."""
    keep = np.zeros(len(weights), bool)
    edges = np.flatnonzero(np.diff(np.r_[0, sums >= least, 0]))
    for surge, dive in zip(edges[::2], edges[1::2], strict=True):  # the block that ends with line i is block i
        start, end = max(0, surge - BLOCK_LINES + 1), min(dive, len(weights))
        own = np.flatnonzero(weights[start:end])
        if len(own):
            keep[start + own[0] : start + own[-1] + 1] = True
    return keep


def unlinked(x: Line) -> int:
    """Characters of a line outside of links; none where four fifths are links."""
    return len(x.text) - x.linked if 5 * x.linked < 4 * len(x.text) else 0


def streams(lines: list[Line]) -> list[list[Line]]:
    """The lines that may be the page's text, best first: those of its article or else all outside of noise, those around an article, and those named like noise.

    Wrappers that are named like noise, but hold an article, main or h1 element, count as the page's own if they hold more text (in
    articles, or else at all) than the rest of the page. Outside of articles, links that stand line by line are a menu and go."""

    def mass(level: int) -> int:
        own = [(unlinked(x), x.main) for x in lines if x.level == level]
        return sum(n for n, main in own if main) or sum(n for n, _ in own)

    plain = WRAPPED if mass(WRAPPED) > mass(PLAIN) else PLAIN
    soft = [x for x in lines if x.level != HARD]
    only_link = [not x.main and unlinked(x) == 0 for x in soft]
    menu = [a and (b or c) for a, b, c in zip(only_link, [False, *only_link], [*only_link[1:], False], strict=False)]
    own = [x for x, listed in zip(soft, menu, strict=True) if x.level <= plain and not listed]
    article = [x for x in own if x.main]
    return [article or own, own if article else [], [x for x in soft if x.level > plain]]


def main_text(page: str | None) -> str:
    """The kept lines of a page, joined by one space.

    Markup is stripped to lines, and each counts up to LINE_CHARS of its length, without its links if it's outside of articles. Their sums over
    blocks of BLOCK_LINES lines choose: text surges where a sum reaches SURGE_SHARE of the greatest, and dives behind the last such
    block. Tags and names tell which lines are looked at first (`streams`), and nothing of what is kept among them; later
    streams only count where the ones before have no text, lines named like noise from NAMED_LEAST characters in a block on."""
    for number, lines in enumerate(streams(lines_of(page or ""))):
        weights = np.array([min(len(x.text) if x.main else unlinked(x), LINE_CHARS) for x in lines], float)
        sums = block_sums(weights) if len(lines) else np.zeros(1)
        if sums.max() > (NAMED_LEAST if number == 2 else 0):
            return " ".join(lines[i].text for i in np.flatnonzero(surging(weights, sums, SURGE_SHARE * sums.max())))
    return ""


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [main_text(x if isinstance(x, str) else None) for x in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(x) for x in text]})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); other columns aren't read.

    Null and empty pages, and pages of noise alone, give an empty text. Repeated rows are extracted each; an
    empty table gives an empty result. Nothing is cut off: a page is read to its end."""
    return pages.select("page_id", "url", "html").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
