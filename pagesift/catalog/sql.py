"""Pieces of SQL the oracles share. The dialect is DuckDB's, regexes are RE2."""

from __future__ import annotations

from pagesift.functions.text import SPACE_CLASS

NL = "chr(10)"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE_CLASS}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def normalise(x: str) -> str:
    blanks = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({blanks}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def unescape(x: str) -> str:
    """The references that occur in the given pages; a page may end within ``&amp;``."""
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{ref}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def escape(x: str) -> str:
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = f"replace({x}, '{char}', '{ref}')"
    return x


def no_tags(x: str, instead: str = "") -> str:
    return f"regexp_replace({x}, '<[^>]*>', '{instead}', 'g')"


# The given pages without scripts, styles and comments.
PLAIN = """plain AS (
  SELECT page_id, url,
         regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs') AS html
  FROM pages)"""

ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"

# What may stand inside a heading, paragraph or list item of the given pages.
INLINE = "(?:[^<]|</?b>|<br>|<a [^>]*>|</a>)*"

# Pages of the documents that ``derived.paged_documents`` makes.
DOC_PAGES = f"""doc_pages AS (
  SELECT doc_id, page_no::INTEGER AS page_no, raw AS text, {normalise("raw")} AS norm
  FROM documents, unnest(string_split(text, {NL})) WITH ORDINALITY AS u(raw, page_no))"""
