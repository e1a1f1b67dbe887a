"""Paged documents: pages as rows, page choice, running text.

A landed document holds its pages in one row, so choosing and joining pages needs no
shuffle. For tables with one row per page there are forms that never gather a whole
document, because a document may be most of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.pageranges import bad_spec_reason, check_spec, page_range
from pagesift.functions.text import normalise_page, strip
from pagesift.plans.choice import key_filter
from pagesift.plans.scratch import written
from pagesift.schema import PROMPT_CHARS


def doc_pages(docs: DataFrame) -> DataFrame:
    """One row per page: doc_id, page_no (from 1), text."""
    pages = docs.select("doc_id", F.posexplode("pages").alias("pos", "raw"))
    return pages.select(
        "doc_id",
        (F.col("pos") + 1).alias("page_no"),
        F.coalesce("raw", F.lit("")).alias("text"),
    )


def chosen_pages_of(pages: Column, spec: str | Column | None = "all", clean: bool = True) -> Column:
    """``array<struct<page_no, text>>`` in page order, for a literal range or a column of ranges."""
    if not isinstance(spec, Column):
        check_spec(spec)
        spec = F.lit(spec)
    indices = F.array_sort(page_range(spec, F.size(pages)))

    def page(index: Column) -> Column:
        text = F.coalesce(F.get(pages, index), F.lit(""))
        return F.struct(
            (index + 1).alias("page_no"), (normalise_page(text) if clean else text).alias("text")
        )

    return F.transform(indices, page)


def select_pages(docs: DataFrame, spec: str | Column = "all", clean: bool = True) -> DataFrame:
    """The chosen pages as rows: doc_id, page_no, text. The other pages are never touched."""
    chosen = docs.select("doc_id", chosen_pages_of(F.col("pages"), spec, clean).alias("chosen"))
    return chosen.select("doc_id", F.explode_outer("chosen").alias("page")).filter(
        "page is not null"
    ).select("doc_id", "page.page_no", "page.text")


def keep_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Page rows named in ``wanted`` (doc_id, page_no). The page number is part of the
    key, so a long document spreads over many tasks."""
    return pages.join(wanted, ["doc_id", "page_no"], "left_semi")


def expand_ranges(specs: DataFrame) -> DataFrame:
    """``specs`` (with spec, total) and the indices named: ``pages``, or a ``reason``."""
    return specs.withColumn("pages", page_range(F.col("spec"), F.col("total"))).withColumn(
        "reason", bad_spec_reason(F.col("spec"))
    )


def doc_char_totals(pages: DataFrame) -> DataFrame:
    """Pages and characters per document. Partial sums are taken before the shuffle."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("total_chars")
    )


def doc_totals(docs: DataFrame, spec: str | Column = "all") -> DataFrame:
    """The same for landed documents, counted in the row."""
    chosen = docs.select("doc_id", chosen_pages_of(F.col("pages"), spec).alias("chosen"))
    chars = F.aggregate(
        "chosen", F.lit(0).cast("bigint"), lambda total, page: total + F.length(page["text"])
    )
    return chosen.select(
        "doc_id", F.size("chosen").cast("bigint").alias("n_pages"), chars.alias("total_chars")
    )


def page_entry(page_no: Column, text: Column) -> Column:
    """A page in a running text."""
    return F.concat(F.lit("[Page "), page_no.cast("string"), F.lit("]\n"), text)


def full_text_of(text_pages: Column) -> Column:
    """The chosen pages as one text, blank ones left out."""
    filled = F.filter(text_pages, lambda p: strip(p["text"]) != "")
    return F.array_join(F.transform(filled, lambda p: page_entry(p["page_no"], p["text"])), "\n\n")


def doc_full_text(docs: DataFrame, spec: str = "all") -> DataFrame:
    """doc_id, full_text."""
    text = full_text_of(chosen_pages_of(F.col("pages"), spec))
    return docs.select("doc_id", text.alias("full_text"))


#: Page numbers of a block. Offsets are summed up over blocks and then within each.
BLOCK = 1000
_JOINT = "\n\n"


def _entries(pages: DataFrame, block: int) -> DataFrame:
    """The pages that a running text shows, with their blocks and their length with a joint."""
    entry = page_entry(F.col("page_no"), F.col("text"))
    shown = pages.filter("doc_id is not null and page_no is not null").filter(strip(F.col("text")) != "")
    shown = shown.select("doc_id", F.col("page_no").cast("long").alias("page_no"), entry.alias("entry"))
    return shown.withColumn("block", F.floor(F.col("page_no") / block)).withColumn(
        "size", (F.length("entry") + len(_JOINT)).cast("long")
    )


def _block_offsets(entries: DataFrame) -> DataFrame:
    """``doc_id, block, before, total``: how much text of the document comes before a block, and
    all of it, joints included. A row for each block, made from sums per task."""
    sizes = entries.groupBy("doc_id", "block").agg(F.sum("size").alias("size"))
    whole = Window.partitionBy("doc_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        "doc_id",
        "block",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(whole).alias("total"),
    )


def _placed(entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """Entries with ``start``, their place in the running text, and ``shown``, the entry with
    the joint that follows it. Each block of a document is a group of its own."""
    within = Window.partitionBy("doc_id", "block").orderBy("page_no", "entry")
    within = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1))
    rows = entries.withColumn("within", F.coalesce(within, F.lit(0))).join(offsets, ["doc_id", "block"])
    rows = rows.withColumn("start", F.col("before") + F.col("within"))
    last = F.col("start") + F.col("size") == F.col("total")
    return rows.withColumn("shown", F.when(last, F.col("entry")).otherwise(F.concat("entry", F.lit(_JOINT))))


def text_chunks(pages: DataFrame, size: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """The running text of documents with one row per page: doc_id, chunk_no (from 0), text.

    Put together in order, the chunks are the text that ``doc_full_text`` gives for a landed
    document. Every chunk but the last of a document has ``size`` characters. Nothing gathers more
    than a chunk or a block of pages, so a document may be most of the table. Where a page
    lies in the text is a sum over the blocks before it and over its block. Pages with
    one number follow each other by text. Rows without document or page number and blank
    pages are left out, and so are documents without any other.
    """
    entries = _entries(pages, block)
    placed = _placed(entries, _block_offsets(entries))
    end = F.col("start") + F.length("shown")
    numbers = F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))

    def piece(number: Column) -> Column:
        begin = F.greatest(number * size, F.col("start"))
        upto = F.least((number + 1) * size, end)
        text = F.substring("shown", (begin - F.col("start") + 1).cast("int"), (upto - begin).cast("int"))
        return F.struct(number.alias("chunk_no"), begin.alias("begin"), text.alias("text"))

    pieces = placed.select("doc_id", F.explode(F.transform(numbers, piece)).alias("piece"))
    in_order = F.sort_array(F.collect_list(F.struct("piece.begin", "piece.text")))
    text = F.array_join(F.transform(in_order, lambda p: p["text"]), "")
    return pieces.groupBy("doc_id", F.col("piece.chunk_no").alias("chunk_no")).agg(text.alias("text"))


def leading_text(pages: DataFrame, limit: int = PROMPT_CHARS, block: int = BLOCK) -> DataFrame:
    """The first ``limit`` characters of each document's running text, from page rows.

    Which blocks of pages begin within the limit is told by lengths alone, before any text is
    shuffled; the pages of other blocks stay behind, but for some that the filter lets
    through. A document gathers ``limit`` characters, whatever the limit and its pages. Treats
    odd rows like ``text_chunks``.
    """
    entries = _entries(pages, block)
    offsets = written(_block_offsets(entries), "blocks")
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.col("block").cast("string"))
    # Nearly all documents have but one block; the others' later blocks are few.
    later = offsets.filter((F.col("block") > 0) & (F.col("before") < limit)).select(key.alias("key"))
    near = entries.filter((F.col("block") <= 0) | key_filter(later, "key")(key))
    near = near.withColumn("entry", F.substring("entry", 1, limit))
    placed = _placed(near, offsets).filter(F.col("start") < limit)
    cut = F.substring("shown", F.lit(1), (limit - F.col("start")).cast("int"))
    in_order = F.sort_array(F.collect_list(F.struct("start", cut.alias("text"))))
    text = F.array_join(F.transform(in_order, lambda p: p["text"]), "")
    return placed.groupBy("doc_id").agg(text.alias("text"))
