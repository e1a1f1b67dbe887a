"""What can be taken from a page: links, text, images, tables, meta tags, records, digests.

The ``*_of`` functions are column expressions over a node array; the functions that
take ``pages`` run them over a corpus. Nothing here shuffles: a page is one row from
the scan to the extracted array, and its nodes are limited to the tags in use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.nodes import (
    at,
    attr,
    ids_with_tag,
    inside,
    node_text,
    node_text_spaced,
    not_noise,
    only_string,
    with_tag,
)
from pagesift.functions.text import clean_ws, strip
from pagesift.functions.urls import (
    base_parts,
    clean_href,
    is_pdf_link_digest,
    keep_href,
    resolve_against,
)
from pagesift.operators.css import hits_of
from pagesift.operators.video import blob_of, is_record, video_of
from pagesift.sources.html import Reads, asked_nodes, page_nodes

# The modes and the tags each of them reads.
MODES = ("all", "essential", "links", "text", "images", "tables", "meta", "custom")
TEXT_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote")
HEADING_TAGS = ("h1", "h2", "h3")
DIGEST_TAGS = ("h1", "h2", "p", "li")
TABLE_TAGS = ("table", "tr", "td", "th", "caption")
META_ATTRS = ("name", "property", "content", "http-equiv", "charset")
IMAGE_ATTRS = ("src", "alt", "title", "width", "height")
LINK_ATTRS = ("href", "title", "rel")
DIGEST_BUDGET = 2000
#: What each mode reads of a page. Selectors may read anything.
READS = {
    "all": Reads(("title", *HEADING_TAGS, "p", "a", "img", *TABLE_TAGS), (*LINK_ATTRS, *IMAGE_ATTRS)),
    "essential": Reads(("title", "meta", "a", *DIGEST_TAGS), ("href", "name", "property", "content"), True),
    "links": Reads(("a",), LINK_ATTRS),
    "text": Reads(TEXT_TAGS, ()),
    "images": Reads(("img",), IMAGE_ATTRS),
    "tables": Reads(TABLE_TAGS, ()),
    "meta": Reads(("meta",), META_ATTRS),
}


def _nodes(pages: DataFrame, tags: tuple[str, ...], attrs: tuple[str, ...] = (), **options) -> DataFrame:
    """Node arrays limited to what a mode reads, with the page URL taken apart once."""
    parsed = page_nodes(pages, tags=tags, attrs=attrs, **options)
    return parsed.withColumn("base", base_parts(F.col("url")))


def _shown(text: Column, clean: bool) -> Column:
    return clean_ws(text) if clean else text


# -- expressions over a node array ---------------------------------------------------


def links_of(nodes: Column, base: Column, clean: bool = True) -> Column:
    """``array<struct<text, href, title, rel>>`` for every ``<a href>`` that is no script link."""
    anchors = F.filter(
        nodes, lambda n: (n["tag"] == "a") & keep_href(clean_href(n["attrs"].getItem("href")))
    )
    return F.transform(
        anchors,
        lambda a: F.struct(
            _shown(node_text(nodes, a), clean).alias("text"),
            resolve_against(base, clean_href(attr(a, "href"))).alias("href"),
            attr(a, "title").alias("title"),
            clean_ws(attr(a, "rel")).alias("rel"),
        ),
    )


def hrefs_of(nodes: Column, base: Column, among: Callable[[Column], Column] | None = None) -> Column:
    """The targets alone of ``links_of``; of those that ``among`` holds for as they are written, if given."""
    hrefs = F.transform(with_tag(nodes, "a"), lambda a: clean_href(a["attrs"].getItem("href")))
    kept = F.filter(hrefs, lambda href: keep_href(href) & among(href) if among else keep_href(href))
    return F.transform(kept, lambda href: resolve_against(base, href))


def text_blocks_of(nodes: Column, clean: bool = True) -> Column:
    """``array<struct<tag, content>>``; a paragraph in a list item appears as both."""
    blocks = F.transform(
        with_tag(nodes, *TEXT_TAGS),
        lambda n: F.struct(n["tag"].alias("tag"), _shown(node_text(nodes, n), clean).alias("content")),
    )
    return F.filter(blocks, lambda b: b["content"] != "")


def images_of(nodes: Column, base: Column) -> Column:
    """``array<struct<src, alt, title, width, height>>`` for images with a source."""
    with_src = F.filter(nodes, lambda n: (n["tag"] == "img") & (strip(attr(n, "src")) != ""))
    return F.transform(
        with_src,
        lambda n: F.struct(
            resolve_against(base, strip(attr(n, "src"))).alias("src"),
            *[attr(n, name).alias(name) for name in IMAGE_ATTRS[1:]],
        ),
    )


def tables_of(nodes: Column, clean: bool = True) -> Column:
    """``array<struct<table_index, caption, has_header, rows>>``.

    Rows and cells are sought at any depth, so a nested table also shows in the outer
    one. The index counts all tables, also those dropped for having no filled row.
    """

    def row_cells(row_id: Column) -> Column:
        cells = ids_with_tag(nodes, inside(at(nodes, row_id)), "td", "th")
        return F.transform(cells, lambda i: _shown(node_text(nodes, at(nodes, i)), clean))

    def one(table: Column, index: Column) -> Column:
        body = inside(table)
        caption = at(nodes, F.get(ids_with_tag(nodes, body, "caption"), F.lit(0)))
        rows = F.transform(ids_with_tag(nodes, body, "tr"), row_cells)
        return F.struct(
            index.alias("table_index"),
            F.coalesce(clean_ws(node_text(nodes, caption)), F.lit("")).alias("caption"),
            F.exists(body, lambda i: at(nodes, i)["tag"] == "th").alias("has_header"),
            F.filter(rows, lambda r: F.exists(r, lambda c: c != "")).alias("rows"),
        )

    tables = F.transform(with_tag(nodes, "table"), one)
    return F.filter(tables, lambda t: F.size(t["rows"]) > 0)


def meta_of(nodes: Column) -> Column:
    """``array<struct<name, property, content, http_equiv, charset>>``, all-empty tags dropped."""
    tags = F.transform(
        with_tag(nodes, "meta"),
        lambda n: F.struct(*[attr(n, name).alias(name.replace("-", "_")) for name in META_ATTRS]),
    )
    filled = [name.replace("-", "_") for name in META_ATTRS]
    return F.filter(tags, lambda m: F.concat(*[m[name] for name in filled]) != "")


def title_of(nodes: Column) -> Column:
    """Text of the first ``<title>`` if it holds a single string, else empty."""
    first = F.get(with_tag(nodes, "title"), F.lit(0))
    return F.coalesce(strip(only_string(nodes, first)), F.lit(""))


def texts_of(nodes: Column, *tags: str) -> Column:
    """Cleaned text of each element with one of the tags, blank ones dropped."""
    texts = F.transform(with_tag(nodes, *tags), lambda n: clean_ws(node_text(nodes, n)))
    return F.filter(texts, lambda t: t != "")


def budgeted_of(chunks: Column, budget: int = DIGEST_BUDGET) -> Column:
    """The leading chunks; the one that exceeds the budget is still kept whole.

    At most ``budget`` + 1 non-empty chunks can be kept, which bounds the fold.
    """
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    folded = F.aggregate(
        chunks,
        start,
        lambda acc, c: F.when(acc["used"] > budget, acc).otherwise(
            F.struct(
                (acc["used"] + F.length(c)).alias("used"),
                F.concat(acc["kept"], F.array(c)).alias("kept"),
            )
        ),
    )
    return folded["kept"]


def digest_chunks_of(nodes: Column, clean: bool = True) -> Column:
    """Headings, paragraphs and list items as spaced text, blank ones dropped."""
    chunks = F.transform(
        with_tag(nodes, *DIGEST_TAGS), lambda n: _shown(node_text_spaced(nodes, n), clean)
    )
    return F.filter(chunks, lambda t: t != "")


def digest_of(nodes: Column, base: Column, url: Column, clean: bool = True) -> Column:
    """``struct<url, title, description, main_text, pdf_links>``."""
    description = F.get(
        F.filter(nodes, lambda n: (n["tag"] == "meta") & (n["attrs"].getItem("name") == "description")),
        F.lit(0),
    )
    hrefs = F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "a") & n["attrs"].getItem("href").isNotNull()),
        lambda n: resolve_against(base, strip(n["attrs"].getItem("href"))),
    )
    return F.struct(
        url.alias("url"),
        title_of(nodes).alias("title"),
        F.coalesce(strip(attr(description, "content")), F.lit("")).alias("description"),
        strip(F.array_join(budgeted_of(digest_chunks_of(nodes, clean)), "\n")).alias("main_text"),
        distinct_ordered(F.filter(hrefs, is_pdf_link_digest)).alias("pdf_links"),
    )


def distinct_ordered(arr: Column) -> Column:
    """Each element once, where it was first seen."""
    return F.array_distinct(arr)


# -- over a corpus --------------------------------------------------------------------


def links(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per link: page_id, url, pos, text, href, title, rel."""
    parsed = _nodes(pages, ("a",), LINK_ATTRS)
    return explode_items(parsed.withColumn("items", links_of(F.col("nodes"), F.col("base"), clean)))


def link_targets(pages: DataFrame, among: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per page: page_id, url, hrefs in page order; ``among`` is as in ``hrefs_of``."""
    parsed = _nodes(pages, ("a",), ("href",), texts=False)
    return parsed.select("page_id", "url", hrefs_of(F.col("nodes"), F.col("base"), among).alias("hrefs"))


def text_blocks(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per text block: page_id, url, pos, tag, content."""
    parsed = page_nodes(pages, tags=TEXT_TAGS, attrs=())
    return explode_items(parsed.withColumn("items", text_blocks_of(F.col("nodes"), clean)))


def images(pages: DataFrame) -> DataFrame:
    """One row per image: page_id, url, pos, src, alt, title, width, height."""
    parsed = _nodes(pages, ("img",), IMAGE_ATTRS)
    return explode_items(parsed.withColumn("items", images_of(F.col("nodes"), F.col("base"))))


def html_tables(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per table: page_id, url, table_index, caption, has_header, rows."""
    parsed = page_nodes(pages, tags=TABLE_TAGS, attrs=())
    return explode_items(parsed.withColumn("items", tables_of(F.col("nodes"), clean))).drop("pos")


def html_table_cells(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per cell: page_id, url, table_index, row_index, col_index, content."""
    per_row = html_tables(pages, clean).select(
        "page_id", "url", "table_index", F.posexplode("rows").alias("row_index", "cells")
    )
    return per_row.select(
        "page_id", "url", "table_index", "row_index", F.posexplode("cells").alias("col_index", "content")
    )


def meta_tags(pages: DataFrame) -> DataFrame:
    """One row per meta tag: page_id, url, pos, name, property, content, http_equiv, charset."""
    parsed = page_nodes(pages, tags=("meta",), attrs=META_ATTRS)
    return explode_items(parsed.withColumn("items", meta_of(F.col("nodes"))))


def select(pages: DataFrame, css: str, clean: bool = True) -> DataFrame:
    """One row per element a CSS selector hits: page_id, url, index, tag, content, html."""
    parsed = page_nodes(pages, spelled=True)
    return explode_items(parsed.withColumn("items", hits_of(F.col("nodes"), F.col("spelled"), css, clean))).drop("pos")


def page_titles(pages: DataFrame) -> DataFrame:
    """page_id, url, title."""
    parsed = page_nodes(pages, tags=("title",), attrs=())
    return parsed.select("page_id", "url", title_of(F.col("nodes")).alias("title"))


def headings(pages: DataFrame) -> DataFrame:
    """One row per h1-h3: page_id, url, pos, content."""
    parsed = page_nodes(pages, tags=HEADING_TAGS, attrs=())
    return _explode_texts(parsed, texts_of(F.col("nodes"), *HEADING_TAGS))


def paragraphs(pages: DataFrame) -> DataFrame:
    """One row per paragraph: page_id, url, pos, content."""
    return _explode_texts(page_nodes(pages, tags=("p",), attrs=()), texts_of(F.col("nodes"), "p"))


def budgeted_text(pages: DataFrame, budget: int = DIGEST_BUDGET) -> DataFrame:
    """The text chunks of a page that fit its digest: page_id, url, pos, content."""
    parsed = page_nodes(pages, tags=DIGEST_TAGS, attrs=(), keep_noise=True)
    return _explode_texts(parsed, budgeted_of(digest_chunks_of(F.col("nodes")), budget))


def page_record(pages: DataFrame, clean: bool = True, include_meta: bool = False) -> DataFrame:
    """One row per page with every section; ``meta`` is NULL unless asked for."""
    tags = READS["all"].tags + (("meta",) if include_meta else ())
    attrs = READS["all"].attrs + (META_ATTRS if include_meta else ())
    meta = meta_of(F.col("nodes"))
    return _nodes(pages, tags, attrs).select(
        "page_id",
        "url",
        title_of(F.col("nodes")).alias("title"),
        texts_of(F.col("nodes"), *HEADING_TAGS).alias("headings"),
        texts_of(F.col("nodes"), "p").alias("paragraphs"),
        links_of(F.col("nodes"), F.col("base"), clean).alias("links"),
        images_of(F.col("nodes"), F.col("base")).alias("images"),
        tables_of(F.col("nodes"), clean).alias("tables"),
        (meta if include_meta else F.when(F.lit(False), meta)).alias("meta"),
    )


def page_digest(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per page: page_id, url, title, description, main_text, pdf_links."""
    return _digest_nodes(pages).select(
        "page_id", F.inline(F.array(digest_of(F.col("nodes"), F.col("base"), F.col("url"), clean)))
    )


def essential(pages: DataFrame, clean: bool = True) -> DataFrame:
    """One row per page with a ``digest`` or, where a watch page has its data, a ``video``."""
    with_blob = pages.withColumn("blob", blob_of(F.col("html"), F.col("url")))
    parsed = _digest_nodes(with_blob, keep=("page_id", "url", "blob"))
    parsed = parsed.withColumn("data", F.try_parse_json("blob"))
    digest = digest_of(F.col("nodes"), F.col("base"), F.col("url"), clean)
    video = video_of(F.col("data"), F.col("nodes"), F.col("url"))
    found = is_record(F.col("data"))
    return parsed.select(
        "page_id", "url", F.when(~found, digest).alias("digest"), F.when(found, video).alias("video")
    )


def extract(
    pages: DataFrame,
    mode: str,
    selector: str = "",
    clean: bool = True,
    include_meta: bool = False,
) -> DataFrame:
    """One row per page for a mode by name.

    List modes give page_id, url, items; ``all`` gives the sections of ``page_record``
    and ``essential`` the structs of ``essential``. An unknown mode, or ``custom``
    without a selector, raises before anything runs.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode '{mode}'. Valid: {list(MODES)}")
    if mode == "custom" and not selector:
        raise ValueError("CSS selector required for mode='custom'")
    if mode == "all":
        return page_record(pages, clean, include_meta)
    if mode == "essential":
        return essential(pages, clean)
    parsed, items = {
        "links": lambda: (_nodes(pages, ("a",), LINK_ATTRS), links_of(F.col("nodes"), F.col("base"), clean)),
        "text": lambda: (page_nodes(pages, TEXT_TAGS, ()), text_blocks_of(F.col("nodes"), clean)),
        "images": lambda: (_nodes(pages, ("img",), IMAGE_ATTRS), images_of(F.col("nodes"), F.col("base"))),
        "tables": lambda: (page_nodes(pages, TABLE_TAGS, ()), tables_of(F.col("nodes"), clean)),
        "meta": lambda: (page_nodes(pages, ("meta",), META_ATTRS), meta_of(F.col("nodes"))),
        "custom": lambda: (
            page_nodes(pages, spelled=True),
            hits_of(F.col("nodes"), F.col("spelled"), selector, clean),
        ),
    }[mode]()
    return parsed.select("page_id", "url", items.alias("items"))


def result_of(mode: str, nodes: Column, base: Column, url: Column, data: Column, clean: bool = True) -> Column:
    """The result of a mode as a struct: ``items`` of list modes, the sections of ``all``, the
    ``digest`` or ``video`` of ``essential``, for which ``data`` is the video data."""
    if mode == "all":
        return F.struct(
            title_of(nodes).alias("title"),
            texts_of(nodes, *HEADING_TAGS).alias("headings"),
            texts_of(nodes, "p").alias("paragraphs"),
            links_of(nodes, base, clean).alias("links"),
            images_of(nodes, base).alias("images"),
            tables_of(nodes, clean).alias("tables"),
            F.when(F.lit(False), meta_of(nodes)).alias("meta"),
        )
    if mode == "essential":
        found = is_record(data)
        return F.struct(
            F.when(~found, digest_of(nodes, base, url, clean)).alias("digest"),
            F.when(found, video_of(data, nodes, url)).alias("video"),
        )
    items = {
        "links": lambda: links_of(nodes, base, clean),
        "text": lambda: text_blocks_of(nodes, clean),
        "images": lambda: images_of(nodes, base),
        "tables": lambda: tables_of(nodes, clean),
        "meta": lambda: meta_of(nodes),
    }[mode]()
    return F.struct(items.alias("items"))


def extract_asked(
    pages: DataFrame, modes: Sequence[str], asked: str = "asked", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """The columns in ``keep`` and a struct per mode in ``modes``, see ``result_of``, one row per page.

    ``asked`` is a column with the modes asked of each page, an array; the struct of any other
    mode is NULL and not computed. The markup of a page is taken apart in one pass whatever is
    asked of it.
    """
    blob = F.when(F.array_contains(asked, "essential"), blob_of(F.col("html"), F.col("url")))
    with_blob = pages.withColumn("__blob", blob if "essential" in modes else F.lit(None).cast("string"))
    inner = tuple(dict.fromkeys((*keep, "url", asked, "__blob")))
    # The names asked are needed on both sides of the node making.
    twice = with_blob.withColumn("__asked", F.col(asked))
    parsed = asked_nodes(twice, {mode: READS[mode] for mode in modes}, "__asked", inner)
    parsed = parsed.withColumn("__base", base_parts(F.col("url"))).withColumn("__data", F.try_parse_json("__blob"))

    def result(mode: str) -> Column:
        nodes = F.col("noisy" if READS[mode].noise else "nodes")
        found = result_of(mode, nodes, F.col("__base"), F.col("url"), F.col("__data"))
        return F.when(F.array_contains(asked, mode), found).alias(mode)

    return parsed.select(*keep, *[result(mode) for mode in modes])


def node_counts(pages: DataFrame) -> DataFrame:
    """Elements per page and tag, noise left out: page_id, tag, n. Counted in the row,
    as a page is one row: no shuffle."""
    elements = F.filter("nodes", lambda n: not_noise(n) & n["pos"].isNotNull())
    tags = F.transform(elements, lambda n: n["tag"])

    def count(tag: Column, all_tags: Column) -> Column:
        n = F.size(F.filter(all_tags, lambda other: other == tag)).cast("bigint")
        return F.struct(tag.alias("tag"), n.alias("n"))

    counts = let(tags, lambda t: F.transform(F.array_distinct(t), lambda tag: count(tag, t)))
    parsed = page_nodes(pages, attrs=(), keep_noise=True, keep=("page_id",))
    rows = parsed.select("page_id", F.explode_outer(counts).alias("c")).filter("c is not null")
    return rows.select("page_id", "c.tag", "c.n")


def section_counts(records: DataFrame) -> DataFrame:
    """Items per section over all records: section, n."""
    sections = ("headings", "paragraphs", "links", "images", "tables", "meta")
    sizes = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.coalesce(F.size(s), F.lit(0)).alias("items"))
            for s in sections
        ]
    )
    return (
        records.select(F.inline(sizes))
        .groupBy("section")
        .agg(F.sum("items").cast("bigint").alias("n"))
    )


def explode_items(extracted: DataFrame) -> DataFrame:
    """``items`` as rows: page_id, url, pos and the fields of an item."""
    return with_positions(extracted, F.col("items"), "item").select("page_id", "url", "pos", "item.*")


def with_positions(df: DataFrame, items: Column, name: str) -> DataFrame:
    """page_id, url, pos and the item. The outer form with a filter, because for the
    plain form Spark adds a ``size(..) > 0`` filter that computes the array again."""
    rows = df.select("page_id", "url", F.posexplode_outer(items).alias("pos", name))
    return rows.filter("pos is not null")


def _explode_texts(parsed: DataFrame, texts: Column) -> DataFrame:
    return with_positions(parsed, texts, "content")


def _digest_nodes(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    return _nodes(pages, READS["essential"].tags, READS["essential"].attrs, keep_noise=True, keep=keep)
