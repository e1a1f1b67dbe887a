"""Processed documents as text, JSON, Markdown or CSV reports.

Input rows come from ``plans.documents.process_docs``: doc_id, source, op, page_range,
total_pages, text_pages, tables and summary. One report per row, built in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.operators.grids import csv_line, table_csv_rows_of, tables_markdown_of
from pagesift.operators.summaries import has_summary
from pagesift.schema import FORMATS, check_choice

# The wording of reports.
_RULE = "=" * 60
_NO_TEXT_TXT = "(no text on this page)"
_NO_TEXT_MD = "_No text detected on this page._"


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _if(test: Column, lines: Column) -> Column:
    return F.when(test, lines).otherwise(F.array().cast("array<string>"))


#: Where the fields of a processed document are found: columns of a table, or other expressions.
Fields = Callable[[str], Column]


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _any(items: Column) -> Column:
    return F.size(items) > 0


def _at(at: str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at)


def doc_txt(docs: DataFrame, at: str | Column) -> DataFrame:
    """doc_id, body: plain text report."""
    return _bodies(docs, doc_body("txt", at))


def doc_md(docs: DataFrame, at: str | Column) -> DataFrame:
    """doc_id, body: Markdown report."""
    return _bodies(docs, doc_body("md", at))


def doc_json(docs: DataFrame, at: str | Column) -> DataFrame:
    """doc_id, body: ``{"metadata", "summary", "text_pages", "tables"}``; no summary is null."""
    return _bodies(docs, doc_body("json", at))


def doc_csv(docs: DataFrame) -> DataFrame:
    """doc_id, body: the lines of ``doc_report_rows`` as one text per document."""
    return _bodies(docs, doc_body("csv", ""))


def doc_body(fmt: str, at: str | Column, of: Fields = F.col) -> Column:
    """What the file of a document holds, as an expression over its fields."""
    return {"json": _json_body, "csv": _csv_body, "txt": _txt_body, "md": _md_body}[fmt](_at(at), of)


def _txt_body(at: Column, of: Fields) -> Column:

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(label.ljust(12)), value)

    def page(p: Column) -> Column:
        text = F.when(p["text"] != "", p["text"]).otherwise(_NO_TEXT_TXT)
        return F.concat(F.lit("\n--- Page "), p["page_no"].cast("string"), F.lit(" ---\n"), text)

    def table(t: Column) -> Column:
        marker = F.format_string("\n[Page %s, Table %s]", t["page_no"], t["table_index"] + 1)
        underline = F.transform(t["headers"], lambda h: F.repeat(F.lit("-"), F.length(h)))
        head = F.array(_row(t["headers"], " | "), _row(underline, "-+-"))
        rows = F.transform(t["rows"], lambda r: _row(r, " | "))
        return F.array_join(F.concat(F.array(marker), _if(F.size(t["headers"]) > 0, head), rows), "\n")

    head = _lines(
        _RULE,
        "PDF PROCESSING REPORT",
        _RULE,
        fact("File:", of("source")),
        fact("Operation:", of("op")),
        fact("Pages:", of("page_range")),
        fact("Generated:", at),
        _RULE,
        "",
    )
    body = F.concat(
        head,
        _if(_filled(of("summary")), _lines("── AI SUMMARY ──", "", of("summary"), "")),
        _if(_any(of("text_pages")), F.concat(_lines("── EXTRACTED TEXT ──"), F.transform(of("text_pages"), page))),
        _if(_any(of("tables")), F.concat(_lines("", "── TABLES ──"), F.transform(of("tables"), table))),
    )
    return F.array_join(body, "\n")


def _md_body(at: Column, of: Fields) -> Column:
    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {label} | `"), value, F.lit("` |"))

    def page(p: Column) -> Column:
        text = F.when(p["text"] != "", p["text"]).otherwise(_NO_TEXT_MD)
        return F.concat(F.lit("### Page "), p["page_no"].cast("string"), F.lit("\n\n"), text, F.lit("\n"))

    head = _lines(
        "# PDF Processing Report",
        "",
        "| Field | Value |",
        "|---|---|",
        fact("Source", of("source")),
        fact("Operation", of("op")),
        fact("Pages", of("page_range")),
        fact("Generated", at),
        "",
    )
    body = F.concat(
        head,
        _if(_filled(of("summary")), _lines("## AI Summary", "", of("summary"), "")),
        _if(_any(of("text_pages")), F.concat(_lines("## Extracted Text", ""), F.transform(of("text_pages"), page))),
        _if(_any(of("tables")), _lines("## Tables", "", tables_markdown_of(of("tables")))),
    )
    return F.array_join(body, "\n")


def _json_body(at: Column, of: Fields) -> Column:
    metadata = F.struct(
        of("source").alias("source"),
        of("op").alias("op"),
        of("page_range").alias("page_range"),
        of("total_pages").alias("total_pages"),
        at.alias("processed_at"),
    )
    pages = F.map_from_entries(
        F.transform(of("text_pages"), lambda p: F.struct(p["page_no"].cast("string"), p["text"]))
    )
    tables = F.transform(
        of("tables"),
        lambda t: F.struct(
            t["page_no"].alias("page"),
            *[
                t[name].alias(name)
                for name in ("table_index", "caption", "headers", "rows", "row_count", "col_count")
            ],
        ),
    )
    payload = F.struct(
        metadata.alias("metadata"),
        F.nullif(of("summary"), F.lit("")).alias("summary"),
        pages.alias("text_pages"),
        tables.alias("tables"),
    )
    return F.to_json(payload, {"ignoreNullFields": "false"})


def doc_report_rows(docs: DataFrame) -> DataFrame:
    """The lines of a CSV report in order: doc_id, seq, cells, line.

    Tables first, then text, then the summary, each behind a marker row.
    """
    numbered = docs.select("doc_id", F.posexplode_outer(_report_cells(F.col)).alias("seq", "cells"))
    return numbered.filter("seq is not null").withColumn("line", csv_line(F.col("cells")))


def _csv_body(at: Column, of: Fields) -> Column:
    return F.array_join(F.transform(_report_cells(of), csv_line), "\n")


def _report_cells(of: Fields) -> Column:
    rows = F.array().cast("array<array<string>>")

    def block(test: Column, lines: Column) -> Column:
        return F.when(test, lines).otherwise(rows)

    tables = F.flatten(F.transform(of("tables"), lambda t: table_csv_rows_of(t, dash=",")))
    text = F.concat(
        F.array(_lines("# Extracted Text"), _lines("page", "text")),
        F.transform(of("text_pages"), lambda p: F.array(p["page_no"].cast("string"), p["text"])),
    )
    summary = F.array(_lines("# AI Summary"), _lines(of("summary")))
    return F.concat(
        block(_any(of("tables")), tables),
        block(_any(of("text_pages")), text),
        block(_filled(of("summary")), summary),
    )


def render_docs(docs: DataFrame, fmt: str, at: str | Column) -> DataFrame:
    """Bodies (json, txt, md) or lines (csv) in a format by name."""
    check_choice("format", fmt, FORMATS)
    return doc_report_rows(docs) if fmt == "csv" else doc_bodies(docs, fmt, at)


def doc_bodies(docs: DataFrame, fmt: str, at: str | Column) -> DataFrame:
    """doc_id, body in a format by name: what the file of a document holds."""
    check_choice("format", fmt, FORMATS)
    return _bodies(docs, doc_body(fmt, at))


def doc_result_summary(docs: DataFrame) -> DataFrame:
    """doc_id, tables_extracted, has_summary, pages_processed: what a job reports back."""
    return docs.select(
        "doc_id",
        F.size("tables").alias("tables_extracted"),
        has_summary(F.col("summary")).alias("has_summary"),
        F.size("text_pages").alias("pages_processed"),
    )


def _row(cells: Column, joint: str) -> Column:
    return F.concat(F.lit("  "), F.array_join(cells, joint))


def _bodies(docs: DataFrame, body: Column) -> DataFrame:
    return docs.select("doc_id", body.alias("body"))
