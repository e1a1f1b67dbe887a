"""Landed pages, and the step from markup to a node table.

``page_nodes`` is the only place where page data leaves the JVM: HTML needs a stack,
which column expressions do not have. The Python side does nothing but name the
nodes of each page, in document order; every extraction is a Spark expression over
the resulting array.

A node knows its own number (``id``) and that of its last descendant (``last``), so
the content of an element is the slice ``id+1 .. last`` of the array.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Mapping
from functools import partial
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The node code travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What ``page_nodes`` adds on request to find text and markup by offset, see ``_spell``.
SPELLED = "text binary, text_at array<int>, markup binary, begins array<int>, ends array<int>"
_INTS = pa.list_(pa.int32())
_SPELLED = pa.struct(
    [("text", pa.binary()), ("text_at", _INTS), ("markup", pa.binary()), ("begins", _INTS), ("ends", _INTS)]
)

PAGE_SCHEMA = "page_id bigint, url string, html string"
NODE_TYPE = (
    "struct<id: int, last: int, parent: int, tag: string, attrs: map<string, string>, "
    "text: string, noise: boolean, pos: int, next: int>"
)

# Elements whose content is never page text.
NOISE_TAGS = frozenset(("style", "noscript", "iframe"))

# Fixed values (HTML standard): elements without content.
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Fixed values (HTML standard): start tags that end an open paragraph.
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search "
    "section summary table ul".split()
)
_CELL_WALL = frozenset(("td", "th", "caption", "table"))
# Start tag -> (open elements it ends, elements it does not look past).
_ENDS_OWN_KIND = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "option": (frozenset(("option",)), frozenset(("select", "table"))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
}
_PARAGRAPH = frozenset(("p",))
_TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th html body".split())
_RAW_TEXT = {
    "script": re.compile(r"</script(?=[\s/>])", re.I),
    "style": re.compile(r"</style(?=[\s/>])", re.I),
}

_NAME = r"[^\s/>][^\s/>=]*+"
_EQUALS = r"\s*+=\s*+"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_MARKUP = re.compile(
    rf"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_EQUALS}{_VALUE})?+)*+)>"
    r"|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+>?)",
    re.S,
)
_ATTRIBUTES = re.compile(rf"({_NAME})(?:{_EQUALS}({_VALUE}))?+")
# A tag that the input ends in is dropped; any other "<" without markup is text.
_CUT_TAG = re.compile(r"</?[a-zA-Z]")
_REFERENCE = re.compile(r"&#?\w+;")


def read_pages(spark: SparkSession, path: str, min_tasks: int | None = None) -> DataFrame:
    """The landed pages. Small inputs with few splits are spread over the cores."""
    return spread(spark.read.schema(PAGE_SCHEMA).parquet(path), min_tasks)


def spread(scan: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Repartition a file scan that would leave more than half of the cores idle.

    Only a scan of few row groups is moved; a large table already has more splits
    than there are cores and is read where it lies.
    """
    wanted = min_tasks or scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() * 2 <= wanted else scan


def page_nodes(
    pages: DataFrame,
    tags: Iterable[str] | None = None,
    attrs: Iterable[str] | None = None,
    keep_noise: bool = False,
    keep: tuple[str, ...] = ("page_id", "url"),
    spelled: bool = False,
    texts: bool = True,
) -> DataFrame:
    """One row per page: the columns in ``keep``, and its ``nodes``; with ``spelled`` also the
    struct ``spelled``, in which the text and the markup of any node are found by offset.

    ``tags`` and ``attrs`` limit what is emitted, because Spark cannot prune columns
    or array elements through Python; text comes along when an emitted element holds
    it, unless ``texts`` is off. ``keep_noise`` keeps style, noscript and iframe content,
    marked ``noise``.
    """
    columns = [pages.schema[name] for name in keep]
    nodes = T.StructField("nodes", T.ArrayType(T.StructType.fromDDL(NODE_TYPE[7:-1])))
    to_nodes = partial(
        _batches_to_nodes,
        tags=None if tags is None else frozenset(tags),
        attrs=None if attrs is None else frozenset(attrs),
        keep_noise=keep_noise,
        spelled=spelled,
        texts=texts,
    )
    more = [T.StructField("spelled", T.StructType.fromDDL(SPELLED))] if spelled else []
    return pages.select(*keep, "html").mapInArrow(to_nodes, T.StructType([*columns, nodes, *more]))


class Reads(NamedTuple):
    """The tags and attributes that something needs of a page; ``noise`` if also those under noise."""

    tags: tuple[str, ...]
    attrs: tuple[str, ...]
    noise: bool = False


def asked_nodes(
    pages: DataFrame, reads: Mapping[str, Reads], asked: str, keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """One row per page: the columns in ``keep``, ``nodes`` and ``noisy``, in one pass over the markup.

    ``asked`` is a column with names from ``reads``, an array for each page. ``nodes`` has what
    the names asked of this page read, noise left out, ``noisy`` what those read that see noise
    too; an array for which nothing is asked is empty and costs nothing.
    """
    columns = [pages.schema[name] for name in keep]
    kind = T.ArrayType(T.StructType.fromDDL(NODE_TYPE[7:-1]))
    schema = T.StructType([*columns, T.StructField("nodes", kind), T.StructField("noisy", kind)])
    return pages.select(*keep, asked, "html").mapInArrow(partial(_batches_to_asked, reads=dict(reads)), schema)


def _batches_to_asked(
    batches: Iterator[pa.RecordBatch], reads: Mapping[str, Reads]
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.schema.names[:-2]
        asked, html = batch.column(len(kept)), batch.column(len(kept) + 1)
        first, outs = 0, (_NodeColumns(), _NodeColumns())
        for row in range(batch.num_rows):
            wanted = [reads[name] for name in asked[row].as_py() or () if name in reads]
            for out, noise in zip(outs, (False, True), strict=True):
                parts = [r for r in wanted if r.noise == noise]
                if parts:
                    tags = frozenset(tag for r in parts for tag in r.tags)
                    attrs = frozenset(name for r in parts for name in r.attrs)
                    _add_page(out, html[row].as_py() or "", tags, attrs, noise)
                else:
                    out.page_ends.append(len(out.tag))
            if sum(len(out.tag) for out in outs) >= 100_000 or row == batch.num_rows - 1:
                part = batch.slice(first, row + 1 - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-2], *(out.to_arrow() for out in outs)], names=[*kept, "nodes", "noisy"]
                )
                first, outs = row + 1, (_NodeColumns(), _NodeColumns())


def _batches_to_nodes(
    batches: Iterator[pa.RecordBatch],
    tags: frozenset | None,
    attrs: frozenset | None,
    keep_noise: bool,
    spelled: bool = False,
    texts: bool = True,
) -> Iterator[pa.RecordBatch]:
    """Turn page batches into node batches of bounded size."""
    for batch in batches:
        kept = batch.schema.names[:-1]
        first, out, spellings = 0, _NodeColumns(), []
        for row in range(batch.num_rows):
            _add_page(out, batch.column(len(kept))[row].as_py() or "", tags, attrs, keep_noise, texts)
            if spelled:
                spellings.append(_spell(out, out.page_ends[-2]))
            if len(out.tag) >= 100_000 or row == batch.num_rows - 1:
                part = batch.slice(first, row + 1 - first)
                more = {"spelled": pa.array(spellings, _SPELLED)} if spelled else {}
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], out.to_arrow(), *more.values()], names=[*kept, "nodes", *more]
                )
                first, out, spellings = row + 1, _NodeColumns(), []


class _NodeColumns:
    """The nodes of a batch of pages, one list per field."""

    def __init__(self) -> None:
        self.page_ends = [0]
        self.id, self.last, self.parent, self.pos, self.next = [], [], [], [], []
        self.tag, self.text, self.noise = [], [], []
        self.attr_ends, self.attr_keys, self.attr_values = [0], [], []

    def add(self, start: int, parent: int, tag: str, text: str | None, noise: bool, pos: int | None) -> int:
        row = len(self.tag)
        self.id.append(row - start)
        self.last.append(row - start)
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        self.noise.append(noise)
        self.pos.append(pos)
        self.next.append(None)
        self.attr_ends.append(len(self.attr_keys))
        return row

    def to_arrow(self) -> pa.ListArray:
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_ends, pa.int32()),
            pa.array(self.attr_keys, pa.string()),
            pa.array(self.attr_values, pa.string()),
        )
        ints = {n: pa.array(getattr(self, n), pa.int32()) for n in ("id", "last", "parent", "pos", "next")}
        nodes = pa.StructArray.from_arrays(
            [
                ints["id"],
                ints["last"],
                ints["parent"],
                pa.array(self.tag, pa.string()),
                attrs,
                pa.array(self.text, pa.string()),
                pa.array(self.noise, pa.bool_()),
                ints["pos"],
                ints["next"],
            ],
            names=["id", "last", "parent", "tag", "attrs", "text", "noise", "pos", "next"],
        )
        return pa.ListArray.from_arrays(pa.array(self.page_ends, pa.int32()), nodes)


class _Open:
    """An element that is not closed yet."""

    __slots__ = ("name", "row", "holder", "noise", "children", "youngest")

    def __init__(self, name: str, row: int, holder: int, noise: bool) -> None:
        self.name, self.row, self.holder, self.noise = name, row, holder, noise
        self.children, self.youngest = 0, -1


def _add_page(
    out: _NodeColumns,
    html: str,
    tags: frozenset | None,
    attrs: frozenset | None,
    keep_noise: bool,
    texts: bool = True,
) -> None:
    """Append the nodes of one page, repairing the tree where tags are missing."""
    start = len(out.tag)
    stack = [_Open("", -1, -1, False)]
    opened: dict[str, list[int]] = {}  # depths of the open elements of each name
    pending: list[str] = []

    def flush() -> None:
        top = stack[-1]
        if texts and (tags is None or top.holder >= 0) and (keep_noise or not top.noise):
            raw = top.name if top.name in _RAW_TEXT else ""
            text = "".join(pending)
            if not raw and "&" in text:
                text = unescape(text)
            out.add(start, top.holder, f"#{raw or 'text'}", text, top.noise, None)
        pending.clear()

    def close_to(depth: int) -> None:
        end = len(out.tag) - 1 - start
        while len(stack) > depth:
            gone = stack.pop()
            opened[gone.name].pop()
            if gone.row >= 0:
                out.last[gone.row] = end

    def nearest(names: Iterable[str]) -> int:
        depth = 0
        for name in names:
            if (depths := opened.get(name)) and depths[-1] > depth:
                depth = depths[-1]
        return depth

    def find_open(names: Iterable[str], walls: Iterable[str]) -> int:
        """Depth of the nearest open element with one of the names, 0 if none is in reach."""
        if stack[-1].name in names:
            return len(stack) - 1  # nothing lies deeper
        depth = nearest(names)
        return depth if depth and depth >= nearest(walls) else 0

    def open_element(name: str, source: str) -> None:
        if opened.get("p") and name in _ENDS_PARAGRAPH and (depth := find_open(_PARAGRAPH, _CELL_WALL)):
            close_to(depth)
        if (own := _ENDS_OWN_KIND.get(name)) and (depth := find_open(*own)):
            close_to(depth)
        parent = stack[-1]
        noise = parent.noise or name in NOISE_TAGS
        kept = keep_noise or not noise
        if kept:
            parent.children += 1
        element = _Open(name, -1, parent.holder, noise)
        if kept and (tags is None or name in tags):
            element.row = out.add(start, parent.holder, name, None, noise, parent.children)
            element.holder = element.row - start
            if parent.youngest >= 0:
                out.next[parent.youngest] = element.holder
            parent.youngest = element.row
            if source:
                seen = _attributes(source, attrs)
                out.attr_keys.extend(seen)
                out.attr_values.extend(seen.values())
                out.attr_ends[-1] = len(out.attr_keys)
        if name not in _VOID:
            opened.setdefault(name, []).append(len(stack))
            stack.append(element)

    at = 0
    while True:
        tag_at = html.find("<", at)
        if tag_at < 0:
            break
        markup = _MARKUP.match(html, tag_at)
        if markup is None:
            pending.append(html[at:tag_at])
            if _CUT_TAG.match(html, tag_at):
                at = len(html)
                break
            pending.append("<")
            at = tag_at + 1
            continue
        if tag_at > at:
            pending.append(html[at:tag_at])
        at = markup.end()
        name = markup[2]
        if name is None:
            if pending:
                flush()
            continue
        name = name.lower()
        if markup[1]:
            if depth := find_open((name,), () if name in _TABLE_PARTS else _CELL_WALL):
                if pending:
                    flush()
                close_to(depth)
            continue
        if pending:
            flush()
        open_element(name, markup[3])
        if name in _RAW_TEXT:
            ending = _RAW_TEXT[name].search(html, at)
            stop = ending.start() if ending else len(html)
            if stop > at:
                pending.append(html[at:stop])
            at = stop
    if at < len(html):
        pending.append(html[at:])
    if pending:
        flush()
    close_to(1)
    out.page_ends.append(len(out.tag))


def _spell(out: _NodeColumns, start: int) -> dict:
    """The text and the markup of a page, written anew in one pass over its nodes.

    All text inside node ``i`` lies from ``text_at[i]`` to ``text_at[last + 1]``, its markup from
    ``begins[i]`` to ``ends[i]``, in bytes. Script and style strings are markup, but not text.
    """
    text, markup = bytearray(), bytearray()
    n = len(out.tag) - start
    text_at, begins, ends, open_ = [], [], [0] * n, []

    def close_before(number: int) -> None:
        while open_ and out.last[start + open_[-1]] < number:
            gone = open_.pop()
            markup.extend(f"</{out.tag[start + gone]}>".encode())
            ends[gone] = len(markup)

    for number in range(n):
        row = start + number
        close_before(number)
        text_at.append(len(text))
        begins.append(len(markup))
        tag = out.tag[row]
        if out.pos[row] is None:
            string = out.text[row]
            if tag == "#text":
                text.extend(string.encode())
                string = _escaped(string)
            markup.extend(string.encode())
            ends[number] = len(markup)
            continue
        of = slice(out.attr_ends[row], out.attr_ends[row + 1])
        pairs = zip(out.attr_keys[of], out.attr_values[of], strict=True)
        attrs = "".join(f" {key}={_quoted(_escaped(value))}" for key, value in pairs)
        markup.extend(f"<{tag}{attrs}{'/>' if tag in _VOID else '>'}".encode())
        ends[number] = len(markup)
        if tag not in _VOID:
            open_.append(number)
    close_before(n)
    return {"text": bytes(text), "text_at": [*text_at, len(text)], "markup": bytes(markup), "begins": begins, "ends": ends}


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    if '"' not in value:
        return f'"{value}"'
    if "'" not in value:
        return f"'{value}'"
    return '"' + value.replace('"', "&quot;") + '"'


def _attributes(source: str, wanted: frozenset | None) -> dict[str, str]:
    """Attributes of a start tag: names in lower case, the first of a name wins."""
    seen: dict[str, str] = {}
    for name, value in _ATTRIBUTES.findall(source):
        name = name.lower()
        if (wanted is None or name in wanted) and name not in seen:
            if value[:1] in ('"', "'"):
                value = value[1:-1]
            seen[name] = _REFERENCE.sub(lambda ref: unescape(ref[0]), value) if "&" in value else value
    return seen
