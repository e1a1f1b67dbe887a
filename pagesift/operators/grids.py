"""Tables found in documents: raw cell grids cleaned, shaped and rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.text import clean_cell, default_headers, md_escape, pad_row

# Fixed value: a first row with a cell this long is data, not a header.
HEADER_CELL_LIMIT = 60


def drop_blank_rows(grid: Column) -> Column:
    """Rows with a filled cell. Tested before cleaning: a cell of blanks is filled."""
    return F.filter(grid, lambda row: F.exists(row, lambda c: F.coalesce(c != "", F.lit(False))))


def clean_grid(grid: Column) -> Column:
    """The rows that are kept, their cells cleaned."""
    return F.transform(drop_blank_rows(grid), lambda row: F.transform(row, clean_cell))


def has_header(grid: Column) -> Column:
    """Two rows or more, and only short cells in the first."""
    return (F.size(grid) >= 2) & F.forall(F.get(grid, F.lit(0)), lambda c: F.length(c) < HEADER_CELL_LIMIT)


def table_of(raw: Column) -> Column:
    """A raw grid as a table, NULL when no row is filled."""

    def shaped(grid: Column) -> Column:
        headed = has_header(grid)
        return F.struct(
            raw["page_no"].alias("page_no"),
            raw["table_index"].alias("table_index"),
            F.lit("").alias("caption"),
            F.when(headed, F.get(grid, F.lit(0))).alias("headers"),
            F.when(headed, F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))))
            .otherwise(grid)
            .alias("rows"),
            (F.size(grid) - F.when(headed, 1).otherwise(0)).alias("row_count"),
            F.size(F.get(grid, F.lit(0))).alias("col_count"),
        )

    return let(clean_grid(raw["grid"]), lambda grid: F.when(F.size(grid) > 0, shaped(grid)))


def tables_of_doc(grids: Column) -> Column:
    """All tables of a landed document."""
    return F.filter(F.transform(grids, table_of), lambda t: t.isNotNull())


def doc_tables(docs: DataFrame) -> DataFrame:
    """One row per table: doc_id, page_no, table_index, caption, headers, rows, row_count, col_count."""
    tables = docs.select("doc_id", F.explode_outer(F.transform("grids", table_of)).alias("t"))
    return tables.filter("t is not null").select("doc_id", "t.*")


def shown_headers(table: Column | None = None, style: str = "markdown") -> Column:
    """The headers, or numbered ones."""
    headers, count = _field(table, "headers"), _field(table, "col_count")
    return F.when(F.size(headers) > 0, headers).otherwise(default_headers(count, style))


def table_markdown_of(table: Column) -> Column:
    """Heading, caption, header row and padded rows of one table, ended by an empty line."""

    def cells(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    def lines(headers: Column) -> Column:
        width = F.size(headers)
        heading = F.format_string(
            "### Page %s, Table %s", table["page_no"], table["table_index"] + 1
        )
        caption = F.when(
            table["caption"] != "", F.array(F.concat(F.lit("_"), table["caption"], F.lit("_")))
        ).otherwise(_no_lines())
        body = F.transform(
            table["rows"], lambda r: cells(F.transform(pad_row(r, width), md_escape))
        )
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
        return F.concat(
            F.array(heading), caption, F.array(F.lit(""), cells(headers), rule), body, F.array(F.lit(""))
        )

    return F.array_join(let(shown_headers(table), lines), "\n")


def tables_markdown_of(tables: Column) -> Column:
    """All tables of a document."""
    return F.array_join(F.transform(tables, table_markdown_of), "\n")


def tables_markdown(tables: DataFrame) -> DataFrame:
    """One row per table: doc_id, page_no, table_index, body."""
    return tables.select(
        "doc_id", "page_no", "table_index", table_markdown_of(_row_struct(tables)).alias("body")
    )


def table_csv_rows_of(table: Column, dash: str = " —") -> Column:
    """``array<array<string>>``: marker, headers if any, rows, an empty row."""
    marker = F.format_string(
        f"# Page %s{dash} Table %s", table["page_no"], table["table_index"] + 1
    )
    head = F.when(F.size(table["headers"]) > 0, F.array(table["headers"])).otherwise(_no_rows())
    return F.concat(F.array(F.array(marker)), head, table["rows"], F.array(_no_lines()))


def tables_csv_rows(tables: DataFrame) -> DataFrame:
    """CSV lines in order: doc_id, page_no, table_index, seq, cells, line."""
    rows = table_csv_rows_of(_row_struct(tables))
    numbered = tables.select(
        "doc_id", "page_no", "table_index", F.posexplode_outer(rows).alias("seq", "cells")
    )
    return numbered.withColumn("line", csv_line(F.col("cells")))


def csv_line(cells: Column) -> Column:
    """Cells as a CSV line: quotes only where needed, doubled inside."""
    quoted = F.transform(
        cells,
        lambda c: F.when(
            c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(c),
    )
    lone_blank = (F.size(cells) == 1) & (F.get(cells, F.lit(0)) == "")
    return F.when(lone_blank, '""').otherwise(F.array_join(quoted, ","))


def table_rows_long(tables: DataFrame) -> DataFrame:
    """One row per cell: doc_id, page_no, table_index, row_no, col_no, header, value.

    Short rows are filled up to the header width; a row with more cells than headers
    has no place in a frame and gets NULL headers for what is over.
    """
    headers = shown_headers(style="frame")
    rows = tables.select(
        "doc_id",
        "page_no",
        "table_index",
        headers.alias("names"),
        F.posexplode_outer(F.transform("rows", lambda r: pad_row(r, F.size(headers)))).alias(
            "row_no", "cells"
        ),
    ).filter("row_no is not null")
    cells = rows.select("*", F.posexplode("cells").alias("col_no", "value"))
    return cells.select(
        "doc_id",
        "page_no",
        "table_index",
        "row_no",
        "col_no",
        F.get("names", F.col("col_no")).alias("header"),
        "value",
    )


def table_frame(tables: DataFrame, doc_id: int, page_no: int, table_index: int) -> DataFrame:
    """One table as a DataFrame with a column per header, rows in order of ``row_no``."""
    one = tables.filter(
        (F.col("doc_id") == doc_id)
        & (F.col("page_no") == page_no)
        & (F.col("table_index") == table_index)
    )
    head = one.select(shown_headers(style="frame").alias("names")).first()
    if head is None:
        raise ValueError(f"No table {table_index} on page {page_no} of document {doc_id}")
    rows = one.select(F.posexplode("rows").alias("row_no", "cells"))
    padded = pad_row(F.col("cells"), F.lit(len(head["names"])))
    columns = [F.get(padded, F.lit(i)).alias(name) for i, name in enumerate(head["names"])]
    return rows.select("row_no", *columns)


def _field(table: Column | None, name: str) -> Column:
    return F.col(name) if table is None else table[name]


def _row_struct(tables: DataFrame) -> Column:
    return F.struct(*[c for c in tables.columns if c != "doc_id"])


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _no_rows() -> Column:
    return F.array().cast("array<array<string>>")
