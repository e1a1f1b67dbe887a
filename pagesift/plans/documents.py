"""Documents from landed rows to results and reports, in one narrow plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.pageranges import page_range
from pagesift.operators.grids import tables_of_doc
from pagesift.operators.paged import chosen_pages_of, full_text_of
from pagesift.operators.reports import doc_bodies, doc_body
from pagesift.operators.summaries import answers, summarise
from pagesift.operators.write import write_bodies
from pagesift.schema import DOC_OPS, DOC_TABLE, FORMATS, TEXT_PAGES, check_choice
from pagesift.sources.pdf import doc_info_of

# What each operation computes.
TEXT_OPS = ("extract", "summarize", "all")
TABLE_OPS = ("tables", "all")
SUMMARY_OPS = ("summarize", "all")


def process_docs(
    docs: DataFrame,
    op: str = "all",
    pages: str | Column = "all",
    prompt: str | Column | None = None,
    fn: Callable[[str], str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, op, page_range, info, total_pages,
    text_pages, tables, summary.

    What ``op`` does not ask for is an empty literal in the plan, so Spark neither
    computes nor reads it. Tables count only on chosen pages. ``pages`` and ``prompt`` may
    be columns of ``docs``.
    """
    check_choice("op", op, DOC_OPS)
    spec = pages if isinstance(pages, Column) else F.lit(pages)
    no_pages, no_tables = F.array().cast(TEXT_PAGES), F.array().cast(f"array<{DOC_TABLE}>")
    chosen = chosen_pages_of(F.col("pages"), pages) if op in TEXT_OPS else no_pages
    tables = _tables_on(spec) if op in TABLE_OPS else no_tables
    info = doc_info_of(F.col("pages"), F.col("meta"))
    asked = prompt if isinstance(prompt, Column) else F.lit(prompt)
    done = docs.select(
        "doc_id",
        F.col("url").alias("source"),
        F.lit(op).alias("op"),
        spec.alias("page_range"),
        info.alias("info"),
        F.size("pages").alias("total_pages"),
        chosen.alias("text_pages"),
        tables.alias("tables"),
        *([asked.cast("string").alias("__prompt")] if op in SUMMARY_OPS else []),
    )
    if op not in SUMMARY_OPS:
        return done.withColumn("summary", F.lit(""))
    with_text = done.withColumn("full_text", full_text_of(F.col("text_pages")))
    summarised = summarise(with_text, fn, "full_text", F.col("__prompt")).drop("full_text", "__prompt")
    # A document without any page has nothing to say that there is no text in it.
    summary = F.when(F.size("text_pages") > 0, F.col("summary")).otherwise("")
    return summarised.withColumn("summary", summary)


def _tables_on(spec: Column) -> Column:
    """The tables on the pages of a range."""
    kept = let(
        page_range(spec, F.size("pages")),
        lambda numbers: F.filter("grids", lambda g: F.array_contains(numbers, g["page_no"] - 1)),
    )
    return tables_of_doc(kept)


def bodies_asked(docs: DataFrame, at: str | Column, fn: Callable[[str], str] | None = None) -> DataFrame:
    """``what, body``: the reports asked of each document, in one pass over the documents.

    ``wanted`` of ``docs`` is an array of structs ``kind`` (operation), ``format``, ``prompt`` and
    ``what`` (a key that comes back). Text, tables and each prompt's summary are made once for a
    row, whatever the number of reports; what no report needs is not made.
    """
    no_pages, no_tables = F.array().cast(TEXT_PAGES), F.array().cast(f"array<{DOC_TABLE}>")

    def asked(*ops: str) -> Column:
        return F.exists("wanted", lambda w: w["kind"].isin(*ops))

    def prompt(w: Column) -> Column:
        return F.coalesce(w["prompt"], F.lit(""))

    summarised = F.filter("wanted", lambda w: w["kind"].isin(*SUMMARY_OPS))
    made = docs.select(
        "url",
        "wanted",
        F.size("pages").alias("total"),
        F.when(asked(*TEXT_OPS), chosen_pages_of(F.col("pages"))).otherwise(no_pages).alias("text"),
        F.when(asked(*TABLE_OPS), _tables_on(F.lit("all"))).otherwise(no_tables).alias("found"),
        F.array_distinct(F.transform(summarised, prompt)).alias("prompts"),
    )
    made = made.withColumn("full_text", F.when(F.size("prompts") > 0, full_text_of(F.col("text"))))
    made = made.withColumn("answers", answers(fn, F.col("full_text"), F.col("prompts")))

    def body(w: Column) -> Column:
        kind = w["kind"]
        # A document without any page has nothing to say that there is no text in it.
        summary = F.get("answers", F.array_position("prompts", prompt(w)).cast("int") - 1)
        fields = {
            "source": F.col("url"),
            "op": kind,
            "page_range": F.lit("all"),
            "total_pages": F.col("total"),
            "text_pages": F.when(kind.isin(*TEXT_OPS), F.col("text")).otherwise(no_pages),
            "tables": F.when(kind.isin(*TABLE_OPS), F.col("found")).otherwise(no_tables),
            "summary": F.when(kind.isin(*SUMMARY_OPS) & (F.size("text") > 0), summary).otherwise(""),
        }
        out = F.lit(None).cast("string")
        for fmt in FORMATS:
            out = F.when(w["format"] == fmt, doc_body(fmt, at, fields.__getitem__)).otherwise(out)
        return F.struct(w["what"].alias("what"), out.alias("body"))

    rows = made.select(F.explode_outer(F.transform("wanted", body)).alias("made"))
    return rows.filter("made is not null").select("made.what", "made.body")


def process_and_write(docs: DataFrame, op: str, fmt: str, out: str, at: str | Column, **options) -> str:
    """Process, render and write in one go: a row per document with doc_id and body."""
    return write_bodies(doc_bodies(process_docs(docs, op, **options), fmt, at), out)
