"""HTML extraction by tag-path ratios.

A page is cut into blocks of text (a block ends where a block-level tag begins or ends). Each block
has a tag path from the root. For each path, text length and punctuation are added up over its blocks,
links discounted, and divided by the number of blocks: content paths hold long, punctuated blocks, menus
short ones. The two ratios are smoothed over the blocks in page order, fused into one score of a
path, and paths over a threshold mark content. The region of the main text is the smallest element
that holds nearly all marked text. In it, blocks on marked paths are the main text, with what marked paths can't show: titles,
list items, cells and quotes, which are short by nature, stay unless most of their path's text is links. Text that
stands in other elements of unmarked paths (say, a box between the paragraphs) is left out.

Elements that never hold main text (menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) are known by tag, role or class and left out with all they contain, as their text can be as long as an article's;
where there are article elements, their blocks are the candidates.

Defined results: null or empty html gives an empty text. Text without any tag is one block. Character
references are decoded once. White space inside a block becomes one space. Whole pages are read; time grows with their length, however deeply elements nest.
Rows, repeated ones too, are extracted one by one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from math import exp, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import prepare

#: Fixed values of HTML, by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LIST_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
P_SCOPE = frozenset("article aside body button caption div footer header li main nav section table td th".split())
#: Elements and words in class, id or role that never hold main text.
NEVER = frozenset("aside applet audio button canvas datalist dialog footer form frame frameset head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title video".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies dialog disclaimer disqus footer hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup promo promoted promotion recommended related replies reply search sidebar sponsor sponsored subscribe teaser toolbar widget".split()
)
#: Elements whose text is short by nature.
SHORT = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
#: Gaussian weights of a block's neighbours, the share of the best path's score that marks a path as content, and the share of marked text in the region.
SMOOTH, MARK, HELD = [exp(-(d * d) / 2) for d in range(3)], 0.35, 0.95
#: The share of links in a path's text beyond which its short elements are a list of links.
LINKS = 0.6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|</?[a-zA-Z][^<>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，！？；：、·¿¡]")


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in NEVER or tag == "header" and not in_article:
        return True
    if not attrs.strip():
        return False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            if any(w.lower() in NEVER_WORDS for w in _WORDS.findall(value)):
                return True
        elif name in ("class", "id") and tag == "article" and any(w.lower() in ("comment", "comments", "reply", "teaser", "related", "ad", "advert") for w in _WORDS.findall(value)):
            return True
    return False


class _Page:
    """Blocks of a page: (element, path, text, characters within links). Elements are numbered as they begin, so a parent comes before its children; equal paths of tags have one number."""

    def __init__(self, html: str) -> None:
        self.stack: list[tuple[str, int, bool]] = []  # tag, element, left out
        self.open: dict[str, int] = defaultdict(int)  # open elements by tag
        self.blocks: list[tuple[int, int, str, int]] = []
        self.text: list[str] = []
        self.linked = self.links = 0
        self.parent, self.path, self.tag, self.within, self.articles = [-1], [0], [""], [False], set()
        self.paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _element(self) -> int:
        """The innermost open element."""
        return next((x[1] for x in reversed(self.stack) if x[1] >= 0), 0)

    def _flush(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                e = self._element()
                self.blocks.append((e, self.path[e], text, min(self.linked, len(text))))
            self.text = []
        self.linked = 0

    def _out(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    def _pop_to(self, index: int) -> None:
        self._flush()
        for tag, _, _ in self.stack[index:]:
            self.open[tag] -= 1
        del self.stack[index:]

    def _push(self, tag: str, element: int, out: bool) -> None:
        self.open[tag] += 1
        self.stack.append((tag, element, out))

    def _close(self, tags: set[str] | frozenset, scope: set[str] | frozenset) -> None:
        """Ends the innermost open element of some tags, but not beyond one of scope."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self._pop_to(i)
                return
            if self.stack[i][0] in scope:
                return

    def _add(self, raw: str) -> None:
        if raw and not self._out():
            raw = unescape(raw) if "&" in raw else raw
            self.text.append(raw)
            if self.links:
                self.linked += len(raw.strip())

    def _read(self, html: str) -> None:
        at, low = 0, None
        while True:
            m = _TOKEN.search(html, at)
            self._add(html[at : m.start()] if m else html[at:])
            if m is None:
                break
            at = m.end()
            if m["cdata"] is not None:
                if not self._out():
                    self.text.append(m["cdata"])
                continue
            if not m["tag"]:
                continue
            tag, attrs = m["tag"].lower(), m["attrs"]
            if m["end"]:
                self._end(tag)
                continue
            if tag in VOID:
                if tag == "br":
                    self._add("\n")
                elif tag == "hr":
                    self._flush()
                continue
            self._start(tag, attrs)
            if tag in RAW and not attrs.rstrip().endswith("/"):
                low = html.lower() if low is None or len(low) != len(html) else low
                end = low.find("</" + tag, at) if len(low) == len(html) else html.find("</" + tag, at)
                at = len(html) if end < 0 else end
        self._flush()

    def _start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = 1
            if not self._out() and _unwanted(tag, attrs, False):
                self._push(tag, -1, True)
            return
        self._flush()
        self.links = 0
        if tag in CLOSES_P:
            self._close(frozenset("p"), P_SCOPE)
        if tag in LIST_ENDS:
            self._close(*LIST_ENDS[tag])
        if attrs.rstrip().endswith("/") and tag not in ("p", "div"):
            return
        out = self._out() or _unwanted(tag, attrs, self.open["article"] + self.open["main"] > 0)
        up, e = self._element(), len(self.parent)
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[up], tag), len(self.paths) + 1))
        article = not out and (tag in ("article", "main") or 'role="main"' in attrs or "articleBody" in attrs)
        self.within.append(self.within[up] or article)
        if article:
            self.articles.add(e)
        self._push(tag, e, out)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        inline = tag in INLINE
        if self.open[tag]:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    self._pop_to(i) if not inline else self._pop_inline(i)
                    return
                if inline and self.stack[i][0] not in INLINE or tag == "p" and self.stack[i][0] in P_SCOPE:
                    return
        elif tag == "p":
            self._flush()

    def _pop_inline(self, index: int) -> None:
        for tag, _, _ in self.stack[index:]:
            self.open[tag] -= 1
        del self.stack[index:]


def scores(blocks) -> list[float]:
    """The fused score of each block's path: text and punctuation for each block of the path, smoothed over page order."""
    sums: dict = defaultdict(lambda: [0.0, 0.0, 0])
    for _, path, text, linked in blocks:
        s = sums[path]
        s[0] += len(text) - linked
        s[1] += len(_PUNCT.findall(text)) * (1 - linked / len(text))
        s[2] += 1
    ratio = [log1p(sums[p][0] / sums[p][2]) * log1p(sums[p][1] / sums[p][2]) for _, p, _, _ in blocks]
    smooth = []
    for i in range(len(ratio)):
        near = [(SMOOTH[abs(d)], ratio[i + d]) for d in range(-2, 3) if 0 <= i + d < len(ratio)]
        smooth.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    fused: dict = defaultdict(list)
    for (_, p, _, _), r, s in zip(blocks, ratio, smooth, strict=True):
        fused[p].append((r * s) ** 0.5)
    return [sum(fused[p]) / len(fused[p]) for _, p, _, _ in blocks]


def _region(page: _Page, blocks: list, got: list[float], top: float) -> int:
    """The smallest element that holds nearly all marked text; where it lies in an article, that article, as titles and short parts may stand beside it."""
    held = [0] * len(page.parent)
    for (e, _, text, _), s in zip(blocks, got, strict=True):
        if s >= MARK * top:
            held[e] += len(text)
    total = sum(held)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    at = max(e for e, n in enumerate(held) if n >= HELD * total)  # they are nested, so the last one is the smallest
    up = at
    while up and up not in page.articles:
        up = page.parent[up]
    if up:
        return up
    return page.parent[at] if at and page.tag[at] in SHORT else at  # beside a single paragraph


def main_text(html: str | None) -> str:
    """The main text of a page, one line per block."""
    if not html:
        return ""
    page = _Page(html)
    blocks = [b for b in page.blocks if page.within[b[0]]] or page.blocks
    if not blocks:
        return ""
    got = scores(blocks)
    top = max(got)
    region = _region(page, blocks, got, top)
    inside = [e == region for e in range(len(page.parent))]
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[page.parent[e]]
    here = [(b, s) for b, s in zip(blocks, got, strict=True) if inside[b[0]]]
    links: dict = defaultdict(lambda: [0, 0])
    for (_, path, text, linked), _ in here:
        links[path][0] += linked
        links[path][1] += len(text)
    kept = []
    for (e, path, text, _), s in here:
        linked, length = links[path]
        if page.tag[e] == "h1" or s >= MARK * top or page.tag[e] in SHORT and linked <= LINKS * length:
            kept.append(text)
    return "\n".join(kept)


@F.pandas_udf(StringType())
def _extract(html: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in html], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """Adds text (empty if none) and n_chars, its code points; columns of those names are replaced."""
    prepare(pages.sparkSession)
    return pages.withColumn("text", _extract("html")).withColumn("n_chars", F.length("text").cast("long"))
