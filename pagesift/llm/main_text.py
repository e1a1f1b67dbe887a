"""Main text of web pages by composite text density.

Every node has a density: characters per tag, lifted where few of the characters are link
text and lowered where most are. The node whose children have the largest sum of densities
holds the article. The least dense node between it and the body sets a threshold: blocks
beside that path belong to the article if they are as dense.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.text import add_results, as_strings

# Fixed values (HTML standard).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_FORMATTING = frozenset("a abbr b big cite code em font i label mark s small span strong sub sup tt u".split())
# A start tag ends the nearest open element of the first list, unless one of the second is nearer.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "option": (("option",), ("select", "table")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
}
_WALLS = ("td", "th", "caption", "button", "table")

# What is never part of an article, by element and by words of class, id and role.
_NEVER = frozenset(
    "head nav footer aside form button select input menu dialog svg canvas object video audio map".split()
) | _RAW
_ALWAYS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription paywall signup "
    "comment comments disqus reply replies respond reactions share sharing social related recommended "
    "recommendations outbrain taboola breadcrumb breadcrumbs pagination pager toolbar notice alert "
    "disclaimer complementary navigation search contentinfo skip".split()
)
_LAYOUT_OUT = frozenset(
    "nav navbar menu submenu sidebar side footer foot masthead topbar header widget widgets".split()
)
_ARTICLE = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_TAG = re.compile(
    rf"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>"
    r"|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+>?)",
    re.S,
)
_MARKS = re.compile(rf"(?i)(?<![^\s/\"'])(class|id|role|style|hidden|aria-hidden)(?![^\s=/>])(?:\s*=\s*({_VALUE}))?")
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_CUT = re.compile(r"</?[a-zA-Z]")


def _unwanted(tag: str, attributes: str) -> bool:
    """Whether an element is a menu, header, notice, advert or the like."""
    if tag in _NEVER:
        return True
    if tag in ("html", "body"):
        return False
    layout = tag == "header"
    for name, value in _MARKS.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if _UNSEEN.search(value):
                return True
            continue
        for token in value.split():
            words = [word.lower() for word in _WORDS.findall(token)]
            if not words or words[0] in ("has", "with", "no", "is"):
                continue
            if any(word in _ALWAYS_OUT for word in words):
                return True
            layout = layout or tag not in _HEADINGS and any(word in _LAYOUT_OUT for word in words)
    return layout and tag not in _ARTICLE


class _Page:
    """The nodes of a page in document order, without what is never wanted."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.out = ["#root"], [-1], [False]
        self.chars, self.tags, self.link_chars, self.link_tags = [0], [0], [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text), text None where a block starts or ends
        self.stack = [0]
        self.open: dict[str, list[int]] = {}
        self.blocks = [0]  # depths of open block elements
        self._read(html)

    def _pop_to(self, depth: int) -> None:
        """Close all elements from a depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            tag = self.tag[node]
            self.open[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
                self.events.append((node, None))

    def _nearest(self, names) -> int:
        return max((self.open[name][-1] for name in names if self.open.get(name)), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCK:
            depth = self._nearest(("p",))
            if depth > self._nearest(_WALLS) and tag not in ("html", "body"):
                self._pop_to(depth)
        if tag in _ENDS:
            own, walls = _ENDS[tag]
            depth = self._nearest(own)
            if depth > self._nearest(walls):
                self._pop_to(depth)
        up = self.stack[-1]
        out = self.out[up] or _unwanted(tag, attributes)
        if tag == "header" and out and not self.out[up] and self._nearest(_ARTICLE):
            out = False  # the head of the article itself
        node = len(self.tag)
        if tag == "br":
            self.events.append((up, " "))
        if tag in _VOID:
            if not out:
                self._count(up, tags=1)
                if tag == "hr":
                    self.events.append((up, None))
            return
        self.tag.append(tag)
        self.parent.append(up)
        self.out.append(out)
        link = tag == "a"
        for of, n in ((self.chars, 0), (self.tags, 0 if out else 1), (self.link_chars, 0), (self.link_tags, int(link and not out))):
            of.append(n)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCK:
            self.blocks.append(len(self.stack))
            self.events.append((node, None))
        self.stack.append(node)

    def _count(self, node: int, tags: int = 0) -> None:
        self.tags[node] += tags

    def _end(self, tag: str) -> None:
        depths = self.open.get(tag)
        if not depths:
            return
        if tag in _FORMATTING and depths[-1] < self.blocks[-1]:
            return  # an inline end tag does not close the blocks begun within it
        if tag not in _WALLS and tag not in ("tr", "tbody", "thead", "tfoot") and depths[-1] < self._nearest(_WALLS):
            return
        self._pop_to(depths[-1])

    def _text(self, text: str) -> None:
        node = self.stack[-1]
        if text and not self.out[node]:
            if "&" in text:
                text = unescape(text)
            self.events.append((node, text))
            n = len("".join(text.split()))
            self.chars[node] += n
            if self.open.get("a"):
                self.link_chars[node] += n

    def _read(self, html: str) -> None:
        at = 0
        while at < len(html):
            found = _TAG.search(html, at)
            if not found:
                rest = html[at:]
                cut = _CUT.search(rest)
                self._text(rest[: cut.start()] if cut else rest)
                break
            self._text(html[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            tag = found[2].lower()
            if found[1]:
                self._end(tag)
                continue
            self._start(tag, found[3])
            if tag in _RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else len(html)
        self._pop_to(1)

    def sums(self) -> None:
        """Add the counts of every node to its ancestors."""
        for node in range(len(self.tag) - 1, 0, -1):
            if not self.out[node]:
                up = self.parent[node]
                for of in (self.chars, self.tags, self.link_chars, self.link_tags):
                    of[up] += of[node]


def _densities(page: _Page) -> list[float]:
    ratio = page.link_chars[0] / max(1, page.chars[0])
    out = []
    for chars, tags, link_chars, link_tags in zip(
        page.chars, page.tags, page.link_chars, page.link_tags, strict=True
    ):
        if not chars:
            out.append(0.0)
            continue
        plain = max(1, chars - link_chars)
        base = math.log(chars / plain * link_chars + ratio * chars + math.e)
        lift = math.log(max(1.0, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / base
        out.append(chars / max(1, tags) * lift)
    return out


def _chosen(page: _Page) -> set[int]:
    """The roots of the article."""
    page.sums()
    density = _densities(page)
    total = [0.0] * len(density)
    for node in range(1, len(density)):
        if not page.out[node]:
            total[page.parent[node]] += density[node]
    best = max(range(len(total)), key=lambda n: (total[n] if not page.out[n] else -1.0, -n))
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    for kind in ("article", "main"):
        holder = next((n for n in path if page.tag[n] == kind), None)
        if holder is not None:
            return {holder}
    inner = [n for n in path if page.tag[n] not in ("#root", "html")]
    threshold = min((density[n] for n in inner), default=0.0)
    on_path, roots = set(path), {best}
    for node in range(1, len(density)):
        beside = page.parent[node] in on_path and node not in on_path and page.parent[node] != best
        if beside and not page.out[node] and page.chars[node]:
            dense = density[node] >= threshold and 2 * page.link_chars[node] < page.chars[node]
            if dense or page.tag[node] == "h1":
                roots.add(node)
    return roots


def _menu(page: _Page, node: int) -> bool:
    """A list or box that is nothing but several links."""
    many = page.link_tags[node] >= 3 and page.tag[node] in ("ul", "ol", "div", "section", "table", "dl")
    return many and 10 * page.link_chars[node] > 9 * page.chars[node]


def main_text(html: str) -> str:
    """The article of a page: its blocks in order, one per line."""
    page = _Page(html)
    if not page.events:
        return ""
    roots = _chosen(page)
    wanted = [False] * len(page.tag)
    wanted[0] = 0 in roots
    for node in range(1, len(page.tag)):
        inside = (node in roots or wanted[page.parent[node]]) and not page.out[node]
        wanted[node] = inside and not _menu(page, node)
    blocks, block = [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            line = " ".join("".join(block).split())
            if line:
                blocks.append(line)
            block = []
        elif wanted[node]:
            block.append(text)
    return "\n".join(blocks)


def extract_main_text(pages: DataFrame, carry=("page_id", "url")) -> DataFrame:
    """The columns in ``carry``, ``text`` and ``n_chars`` (its code points) of every page.

    A missing or empty page has an empty text, and so has one without an article. Whole
    pages are read, whatever their length, in time proportional to it. Equal pages have
    equal texts; missing ids and URLs stay missing; other columns are ignored. An empty
    table gives an empty table. Comments of readers count as boilerplate.
    """

    def make() -> Callable:
        def per_batch(column: pa.Array) -> list[pa.Array]:
            texts = [main_text(html) for html in as_strings(column)]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

        return per_batch

    extracted = add_results(pages, carry, make, "__main string, __size bigint", text="html")
    return extracted.select(*carry, F.col("__main").alias("text"), F.col("__size").alias("n_chars"))
