"""Extracted pages as JSON, CSV rows, text or Markdown.

Every rendering is a string column, one body per page, built in the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import bool_cell, first_filled, md_cell
from pagesift.operators.grids import csv_line
from pagesift.schema import FORMATS, check_choice

# Fixed value: longest cell in a Markdown table.
MD_CELL_LIMIT = 120
# The fields of an item per mode, in order.
FIELDS = {
    "links": ("text", "href", "title", "rel"),
    "text": ("tag", "content"),
    "images": ("src", "alt", "title", "width", "height"),
    "tables": ("table_index", "caption", "has_header", "rows"),
    "meta": ("name", "property", "content", "http_equiv", "charset"),
    "custom": ("index", "tag", "content", "html"),
}
# The sections of a record per mode, in order, and what they hold.
SECTIONS = {
    "all": (
        ("title", "value"),
        ("headings", "values"),
        ("paragraphs", "values"),
        ("links", "items"),
        ("images", "items"),
        ("tables", "items"),
        ("meta", "items"),
    ),
    "essential": (
        ("url", "value"),
        ("title", "value"),
        ("description", "value"),
        ("main_text", "value"),
        ("pdf_links", "values"),
    ),
}
# The fields of a video record, in order; one is a flag.
VIDEO_FIELDS = (
    "platform", "url", "video_id", "title", "channel", "short_description", "duration_seconds",
    "view_count", "publish_date", "category", "thumbnail", "is_live",
)
# First-seen order of the fields when all sections are stacked.
FLAT_FIELDS = (
    "value", "text", "href", "title", "rel", "src", "alt", "width", "height",
    "table_index", "caption", "has_header", "rows", "name", "property", "content",
    "http_equiv", "charset",
)
_SECTION_ROWS = "array<struct<section: string, value: string>>"
#: Where the fields of a result are found: columns of a table, or fields of a struct.
Fields = Callable[[str], Column]
_TYPED = {"table_index": "int", "index": "int", "has_header": "bool", "rows": "json"}


def scalar_cell(item: Column, field: str) -> Column:
    """A field as text: flags capitalised, lists as JSON."""
    kind = _TYPED.get(field)
    if kind == "bool":
        return bool_cell(item[field])
    if kind == "json":
        return F.to_json(item[field])
    return item[field].cast("string")


def item_text(item: Column, mode: str) -> Column:
    """The first filled one of content, text, href; else the whole item as JSON."""
    present = [item[f] for f in ("content", "text", "href") if f in FIELDS[mode]]
    return F.coalesce(first_filled(*present), F.to_json(item)) if present else F.to_json(item)


def _lines(*lines: Column | str) -> Column:
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])


def _none() -> Column:
    return F.array().cast("array<string>")


def _code(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"| {label} | `"), value, F.lit("` |"))


def _md_table(items: Column, mode: str) -> Column:
    fields = FIELDS[mode]
    head = _lines("| " + " | ".join(fields) + " |", "|" + "---|" * len(fields))
    rows = F.transform(
        items,
        lambda item: F.concat(
            F.lit("| "),
            F.concat_ws(" | ", *[md_cell(scalar_cell(item, f), MD_CELL_LIMIT) for f in fields]),
            F.lit(" |"),
        ),
    )
    return F.concat(head, rows)


def _bullets(values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit("- "), v))


def _md_section(name: str, kind: str, value: Column, mode: str) -> Column:
    heading = _lines("## " + name.replace("_", " ").title())
    if kind == "value":
        body = _lines(value)
    else:
        filled = _bullets(value) if kind == "values" else _md_table(value, name)
        body = F.when(F.size(value) > 0, filled).otherwise(_lines("_(empty)_"))
    return F.concat(heading, body, _lines(""))


def _txt_section(name: str, kind: str, value: Column) -> Column:
    heading = _lines(f"--- {name.upper()} ---")
    if kind == "value":
        body = _lines(F.concat(F.lit("  "), value))
    elif kind == "values":
        body = F.transform(value, lambda v: F.concat(F.lit("  "), v))
    else:
        body = F.transform(
            value,
            lambda item: F.concat(
                F.lit("  "),
                F.concat_ws(
                    "  |  ",
                    *[
                        F.concat(F.lit(f"{f}: "), F.coalesce(scalar_cell(item, f), F.lit("")))
                        for f in FIELDS[name]
                    ],
                ),
            ),
        )
    return F.concat(heading, body, _lines(""))


def _sections(of: Fields, mode: str, video: Sequence[str] = VIDEO_FIELDS) -> list[tuple[str, str, Column]]:
    """Name, kind and value of every section; one that is NULL was not asked for.

    An ``essential`` page has a digest or a video record; the sections of the other are NULL.
    """
    if mode != "essential":
        return [(name, kind, of(name)) for name, kind in SECTIONS[mode]]
    digest = [(name, kind, of("digest")[name]) for name, kind in SECTIONS[mode]]
    record = of("video")
    return digest + [(name, "value", F.when(record.isNotNull(), _video_cell(record[name], name))) for name in video]


def _video_cell(value: Column, name: str) -> Column:
    shown = bool_cell(value) if name == "is_live" else value.cast("string")
    return F.coalesce(shown, F.lit(""))


def _record_lines(sections: list[tuple[str, str, Column]], section) -> Column:
    """The lines of all sections that were asked for."""
    return F.concat(
        *[F.when(value.isNotNull(), section(name, kind, value)).otherwise(_none()) for name, kind, value in sections]
    )


def page_txt(extracted: DataFrame, mode: str, at: str | Column) -> DataFrame:
    """page_id, url, body: numbered lines for a list mode, section blocks for a record."""
    return page_bodies(extracted, mode, "txt", at)


def page_md(extracted: DataFrame, mode: str, at: str | Column) -> DataFrame:
    """page_id, url, body: a facts table, then an item table or headed sections."""
    return page_bodies(extracted, mode, "md", at)


def page_json(extracted: DataFrame, mode: str, at: str | Column) -> DataFrame:
    """page_id, url, body: ``{"metadata": .., "data": ..}``."""
    return page_bodies(extracted, mode, "json", at)


def page_csv(extracted: DataFrame, mode: str) -> DataFrame:
    """page_id, url, body: the header and rows of ``page_csv_rows``, without key and position,
    as one CSV text per page."""
    return page_bodies(extracted, mode, "csv", "")


def _video_names(extracted: DataFrame, mode: str) -> Sequence[str]:
    return extracted.schema["video"].dataType.names if mode == "essential" else ()


def page_body(
    mode: str, fmt: str, at: str | Column, of: Fields = F.col, video: Sequence[str] = VIDEO_FIELDS
) -> Column:
    """What the file of a page holds, as an expression over ``url`` and the fields of its result."""
    body = {"json": _json_body, "csv": _csv_body, "txt": _txt_body, "md": _md_body}[fmt]
    return body(mode, _at(at), of, _sections(of, mode, video) if mode in SECTIONS else [])


def _txt_body(mode: str, at: Column, of: Fields, sections: list[tuple[str, str, Column]]) -> Column:
    head = _lines(F.concat(F.lit("# Scraped: "), F.col("url")), f"# Mode: {mode}", F.concat(F.lit("# At: "), at), "")
    if mode in SECTIONS:
        lines = _record_lines(sections, _txt_section)
    else:
        lines = F.transform(
            of("items"),
            lambda item, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), item_text(item, mode)),
        )
    return F.array_join(F.concat(head, lines), "\n")


def _md_body(mode: str, at: Column, of: Fields, sections: list[tuple[str, str, Column]]) -> Column:
    head = _lines(
        "# Scraped Data",
        "",
        "| Field | Value |",
        "|---|---|",
        _code("URL", F.col("url")),
        f"| Mode | `{mode}` |",
        _code("Scraped at", at),
        "",
    )
    if mode in SECTIONS:
        lines = _record_lines(sections, lambda n, k, v: _md_section(n, k, v, mode))
    else:
        items = of("items")
        lines = F.when(F.size(items) > 0, _md_table(items, mode)).otherwise(_lines("_No items found._"))
    return F.array_join(F.concat(head, lines), "\n")


def _json_body(mode: str, at: Column, of: Fields, sections: list[tuple[str, str, Column]]) -> Column:
    metadata = F.struct(F.col("url").alias("url"), F.lit(mode).alias("mode"), at.alias("scraped_at"))
    if mode == "essential":
        data = F.when(of("digest").isNotNull(), F.to_json(of("digest"))).otherwise(F.to_json(of("video")))
    elif mode == "all":
        data = F.to_json(F.struct(*[of(name).alias(name) for name, _ in SECTIONS["all"]]))
    else:
        data = F.to_json(of("items"))
    return F.concat(F.lit('{"metadata":'), F.to_json(metadata), F.lit(',"data":'), data, F.lit("}"))


def _csv_body(mode: str, at: Column, of: Fields, sections: list[tuple[str, str, Column]]) -> Column:
    if mode in SECTIONS:
        fields = ("section", *(FLAT_FIELDS if mode == "all" else ("value",)))
        rows = _flat_rows(of) if mode == "all" else _section_rows(sections)
        cells = F.transform(rows, lambda row: _filled(*[row[f] for f in fields]))
    else:
        fields = FIELDS[mode]
        cells = F.transform(of("items"), lambda item: _filled(*[scalar_cell(item, f) for f in fields]))
    return F.array_join(F.concat(_lines(",".join(fields)), F.transform(cells, csv_line)), "\n")


def _filled(*cells: Column) -> Column:
    return F.array(*[F.coalesce(cell, F.lit("")) for cell in cells])


def flatten_sections(records: DataFrame) -> DataFrame:
    """Every item of every section as a row: page_id, section, pos and all fields as text.

    The sections are put into one array of one struct type and exploded once. Stacking
    one query per section would read and take apart each page once per section.
    """
    return records.select("page_id", F.explode_outer(_flat_rows(F.col)).alias("row")).select("page_id", "row.*")


def _flat_rows(of: Fields) -> Column:
    """The items of all sections of a record as one array: section, pos, ``FLAT_FIELDS``."""

    def flat(section: str, pos: Column, given: dict[str, Column]) -> Column:
        cells = [given.get(f, F.lit(None).cast("string")).alias(f) for f in FLAT_FIELDS]
        return F.struct(F.lit(section).alias("section"), pos.alias("pos"), *cells)

    def rows_of(section: str, kind: str) -> Column:
        if kind == "value":
            return F.array(flat(section, F.lit(0), {"value": of(section)}))
        if kind == "values":
            return F.transform(of(section), lambda v, i: flat(section, i, {"value": v}))
        return F.transform(
            of(section),
            lambda item, i: flat(section, i, {f: scalar_cell(item, f) for f in FIELDS[section]}),
        )

    parts = [
        F.coalesce(rows_of(name, kind), F.array().cast(_flat_type())) for name, kind in SECTIONS["all"]
    ]
    return F.concat(*parts)


def page_csv_rows(extracted: DataFrame, mode: str) -> DataFrame:
    """The rows of a CSV export: stacked sections, one row per section and value of a digest or
    video record, or the items with every field as text."""
    if mode == "all":
        return flatten_sections(extracted)
    if mode == "essential":
        rows = extracted.select("page_id", F.posexplode(_section_rows(_sections(F.col, mode, _video_names(extracted, mode)))).alias("pos", "row"))
        return rows.select("page_id", "pos", "row.section", "row.value")
    items = extracted.select("page_id", F.posexplode_outer("items").alias("pos", "item"))
    cells = [scalar_cell(F.col("item"), f).alias(f) for f in FIELDS[mode]]
    return items.filter("pos is not null").select("page_id", "pos", *cells)


def _section_rows(sections: list[tuple[str, str, Column]]) -> Column:
    """section, value for each value of each section of a record, as one array."""

    def cells(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("section"), v.alias("value")))

    parts = []
    for name, kind, value in sections:
        values = value if kind == "values" else F.array(value.cast("string"))
        parts.append(F.when(value.isNotNull(), cells(name, values)).otherwise(F.array().cast(_SECTION_ROWS)))
    return F.concat(*parts)


def render_pages(extracted: DataFrame, mode: str, fmt: str, at: str | Column) -> DataFrame:
    """Bodies (json, txt, md) or rows (csv) in a format by name."""
    check_choice("format", fmt, FORMATS)
    return page_csv_rows(extracted, mode) if fmt == "csv" else page_bodies(extracted, mode, fmt, at)


def page_bodies(extracted: DataFrame, mode: str, fmt: str, at: str | Column) -> DataFrame:
    """page_id, url, body in a format by name: what the file of a page holds."""
    check_choice("format", fmt, FORMATS)
    body = page_body(mode, fmt, at, video=_video_names(extracted, mode))
    return extracted.select("page_id", "url", body.alias("body"))


def _flat_type() -> str:
    fields = ", ".join(f"{name}: string" for name in FLAT_FIELDS)
    return f"array<struct<section: string, pos: int, {fields}>>"


def _at(at: str | Column) -> Column:
    return at if isinstance(at, Column) else F.lit(at)

