"""URL columns: parts, predicates, reference resolution, file names.

Parts follow the pattern of RFC 3986, appendix B. ``parse_url`` is not used: it
answers NULL for URLs with spaces, which must be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.binding import let
from pagesift.functions.text import strip

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = {
    "host": r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)",
    "path": r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)",
    "query": r"(?s)^[^?#]*\?([^#]*)",
    "fragment": r"(?s)^[^#]*#(.*)$",
}

# References that need no work: absolute ones, and plain paths from the root. Neither has
# a query or fragment, whose empty forms would have to go, or anything to tidy.
_PLAIN_ABSOLUTE = r"^https?://[^?#\t\r\n]+\z"
_PLAIN_ROOTED = r"^/(?:[^/?#\t\r\n.][^?#\t\r\n]*)?\z"
# References that may end in ``.pdf`` once resolved: their own end says so, apart from what vanishes
# (line breaks, tabs, empty query and fragment), or they have no path, so that the end is the base's.
_MAY_END_IN_PDF = (
    r"(?i)\.[\t\r\n]*p[\t\r\n]*d[\t\r\n]*f[?#\t\r\n]*\z"
    r"|^[\x00-\x20]*(?:[a-z][a-z0-9+.\-\t\r\n]*:)?[/?#\t\r\n]*\z"
)

# Schemes that take relative references.
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
# Hosts and path of video watch pages.
VIDEO_HOSTS = ("www.youtube.com", "youtube.com", "m.youtube.com")
VIDEO_PATH = "/watch"


def url_part(col: Column, part: str) -> Column:
    """``scheme`` (lower case), ``host`` (with port), ``path``, ``query`` or ``fragment``."""
    if part != "scheme" and part not in _PARTS:
        raise ValueError(f"Unknown URL part '{part}'. Valid: {['scheme', *_PARTS]}")
    return _tidy_part(_tidy(col), part)


def url_reject_reason(col: Column) -> Column:
    """NULL for a URL that can be fetched, else why not."""
    scheme, host = url_part(col, "scheme"), url_part(col, "host")
    return (
        F.when(col.isNull(), "missing")
        .when(~scheme.isin("http", "https"), "scheme is not http or https")
        .when(host == "", "no host")
    )


def split_valid_urls(df: DataFrame, col: str = "url") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable URL, and the rejected rows with a ``reason``."""
    tagged = df.withColumn("reason", url_reject_reason(F.col(col)))
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def is_pdf_url(col: Column) -> Column:
    """The path ends in ``.pdf``; query, fragment and ``;parameters`` do not count."""
    path = F.regexp_replace(url_part(col, "path"), ";[^/]*$", "")
    return F.lower(path).endswith(".pdf")


def is_pdf_link_digest(href: Column) -> Column:
    """Digest rule: the text before the first ``?`` ends in ``.pdf``; a fragment counts."""
    return F.substring_index(F.lower(href), "?", 1).endswith(".pdf")


def is_pdf_href(href: Column) -> Column:
    """Follow rule: the whole link ends in ``.pdf``; a query counts."""
    return F.lower(href).endswith(".pdf")


def may_be_pdf_href(href: Column) -> Column:
    """Whether a reference may meet ``is_pdf_href`` once it is resolved; never wrongly no."""
    return href.rlike(_MAY_END_IN_PDF)


def keep_href(href: Column) -> Column:
    """Drop script links only; ``mailto:`` and ``#...`` stay."""
    return ~href.startswith("javascript:")


def is_video_url(col: Column) -> Column:
    """A watch page: one of three hosts, written exactly, with a ``v=`` in the query."""
    return (
        url_part(col, "host").isin(*VIDEO_HOSTS)
        & (url_part(col, "path") == VIDEO_PATH)
        & url_part(col, "query").contains("v=")
    )


def url_filename(col: Column) -> Column:
    """File name for a download: last path segment, with a ``.pdf`` suffix."""
    bare = F.regexp_replace(F.substring_index(col, "?", 1), "/+$", "")
    last = F.substring_index(bare, "/", -1)
    name = F.when(last == "", "downloaded.pdf").otherwise(last)
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def base_parts(url: Column) -> Column:
    """A base URL taken apart once, so that many links can be resolved against it."""
    tidy = _tidy(F.coalesce(url, F.lit("")))
    scheme, host, path = (_tidy_part(tidy, part) for part in ("scheme", "host", "path"))
    return F.struct(
        F.coalesce(url, F.lit("")).alias("url"),
        scheme.alias("scheme"),
        host.alias("host"),
        F.when(
            scheme.isin(*RELATIVE_SCHEMES) & (scheme != "") & (host != ""),
            F.concat(scheme, F.lit("://"), host),
        ).alias("origin"),
        path.alias("path"),
        F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")).alias("folder"),
        _tidy_part(tidy, "query").alias("query"),
    )


def resolve_against(base: Column, href: Column) -> Column:
    """Resolve a reference against ``base_parts``, by RFC 3986 section 5.

    No base leaves the reference as it is, an empty reference gives the base, a
    reference in another scheme stays raw, empty queries and fragments vanish.
    """

    def from_parts(ref: Column) -> Column:
        merged = F.when(ref["path"].startswith("/"), ref["path"]).otherwise(
            _drop_inner_slashes(F.concat(base["folder"], ref["path"]))
        )
        new_path = F.when(ref["path"] == "", base["path"]).otherwise(let(merged, _fold_dots))
        new_query = F.when((ref["path"] == "") & (ref["query"] == ""), base["query"]).otherwise(
            ref["query"]
        )
        own_scheme = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
        return (
            F.when(own_scheme | ~base["scheme"].isin(*RELATIVE_SCHEMES), href)
            .when(
                ref["host"] != "",
                _join(base["scheme"], ref["host"], ref["path"], ref["query"], ref["fragment"]),
            )
            .otherwise(
                let(
                    new_path,
                    lambda path: _join(base["scheme"], base["host"], path, new_query, ref["fragment"]),
                )
            )
        )

    return (
        F.when(base["url"] == "", href)
        .when(href == "", base["url"])
        .when(href.rlike(_PLAIN_ABSOLUTE), href)
        .when(
            base["origin"].isNotNull() & href.rlike(_PLAIN_ROOTED) & ~href.contains("/."),
            F.concat(base["origin"], href),
        )
        .otherwise(let(_tidy(href), lambda ref: let(_parts(ref), from_parts)))
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve one reference against one base URL."""
    return let(base_parts(base), lambda parts: resolve_against(parts, href))


def clean_href(raw: Column) -> Column:
    """An attribute value as a link: whitespace stripped."""
    return strip(raw)


def _tidy_part(url: Column, part: str) -> Column:
    if part == "scheme":
        return F.lower(F.regexp_extract(url, _SCHEME, 1))
    return F.regexp_extract(url, _PARTS[part], 1)


def _parts(url: Column) -> Column:
    return F.struct(*[_tidy_part(url, p).alias(p) for p in ("scheme", *_PARTS)])


def _tidy(url: Column) -> Column:
    """Line breaks and tabs inside a URL, and control characters before it, do not count."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _join(scheme: Column, host: Column, path: Column, query: Column, fragment: Column) -> Column:
    slash = F.when((host != "") & (path != "") & ~path.startswith("/"), "/").otherwise("")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((host != "") | path.startswith("//"), F.concat(F.lit("//"), host)).otherwise(""),
        slash,
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _drop_inner_slashes(path: Column) -> Column:
    """``/a//b`` -> ``/a/b``, as merging with a folder does."""
    return F.when(path.contains("//"), F.regexp_replace(path, "/{2,}", "/")).otherwise(path)


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments. The fold runs only for paths that have some."""

    def fold(body: Column, segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, seg: F.when(
                seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(seg == ".", done)
            .otherwise(F.concat(done, F.array(seg))),
        )
        tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        joined = F.array_join(F.concat(kept, tail), "/")
        return F.concat(F.coalesce(F.nullif(joined, F.lit("")), F.lit("/")), F.substr(path, F.length(body) + 1))

    without_params = F.regexp_replace(path, ";[^/]*$", "")
    folded = let(without_params, lambda body: fold(body, F.split(body, "/")))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:[/;]|$)"), folded).otherwise(path)
