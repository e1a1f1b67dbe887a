"""String columns: whitespace rules, cell rules, padding, headings, key hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.isspace() accepts, as a string and as a
# character class that Java's regex engine and RE2 read alike.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same set in Java's terms, which match faster than the long class.
_RUN = r"(?U)[\s\x1c-\x1f]+"
_BLANKS = r"[ \t]{2,}|\t"


def strip(col: Column) -> Column:
    """Remove whitespace of any kind from both ends (plain ``trim`` removes only spaces)."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def clean_ws(col: Column) -> Column:
    """Turn every whitespace run into one space, then drop the spaces at both ends."""
    return F.trim(F.regexp_replace(col, _RUN, " "))


def normalise_page(col: Column) -> Column:
    """Collapse blanks and tabs, keep at most one empty line in a row, strip."""
    blanks = F.regexp_replace(col, _BLANKS, " ")
    return strip(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def clean_cell(col: Column) -> Column:
    """A grid cell: null is empty, line feeds become spaces, ends stripped, runs kept."""
    return strip(F.replace(F.coalesce(col, F.lit("")), F.lit("\n"), F.lit(" ")))


def md_escape(col: Column) -> Column:
    """Escape the pipe, which ends a cell in a Markdown table."""
    return F.replace(col, F.lit("|"), F.lit("\\|"))


def md_cell(col: Column, limit: int | None = None) -> Column:
    """A Markdown table cell; the cut comes after the escaping."""
    escaped = md_escape(F.coalesce(col, F.lit("")))
    return escaped if limit is None else F.substring(escaped, 1, limit)


def section_title(col: Column) -> Column:
    """``http_equiv`` -> ``Http Equiv``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def bool_cell(col: Column) -> Column:
    """A flag as text, capitalised: ``True`` / ``False``."""
    return F.initcap(col.cast("string"))


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def pad_row(row: Column, width: Column) -> Column:
    """Fill a short row with empty cells up to ``width``; a longer row stays whole."""
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def default_headers(width: Column, style: str = "markdown") -> Column:
    """Names for a table without a header row: ``Col 1..`` or ``col_0..``."""
    if style not in ("markdown", "frame"):
        raise ValueError(f"Unknown header style '{style}'")
    numbers = F.when(width > 0, F.sequence(F.lit(1), F.greatest(width, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    if style == "markdown":
        return F.transform(numbers, lambda i: F.concat(F.lit("Col "), i.cast("string")))
    return F.transform(numbers, lambda i: F.concat(F.lit("col_"), (i - 1).cast("string")))


def hash_key(col: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(col.cast("binary"), 256)


def last_or_blank(arr: Column) -> Column:
    """The last element, or the empty string."""
    return F.coalesce(F.try_element_at(arr, F.lit(-1)), F.lit(""))


def output_name(stem: Column, kind: Column, fmt: Column, ts: Column) -> Column:
    """``{stem}_{kind}_{yyyyMMdd_HHmmss}.{fmt}``; the time is an argument, never the clock."""
    stamp = F.date_format(ts, "yyyyMMdd_HHmmss")
    return F.concat(stem, F.lit("_"), kind, F.lit("_"), stamp, F.lit("."), fmt)


def file_stem(path: Column) -> Column:
    """File name without folders and last suffix; an empty path gives ``pdf``."""
    name = F.substring_index(F.regexp_replace(path, r"/+$", ""), "/", -1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("pdf")).otherwise(stem)
