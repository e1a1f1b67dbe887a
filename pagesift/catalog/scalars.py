"""Queries on the scalar functions: URLs, whitespace, cells, names, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.catalog.pages import given_pages
from pagesift.catalog.registry import query, table
from pagesift.catalog.sql import ORIGIN, clean, strip
from pagesift.functions import text as T
from pagesift.functions import urls as U
from pagesift.operators.grids import drop_blank_rows
from pagesift.sources import pdf
from pagesift.sources.requests import job_requests, rejected_requests


def _variants(df, key: str, cases: dict[str, object]):
    """Each row once per case: key, n and the value a case makes of it."""
    made = F.array(*[F.struct(F.lit(n).alias("n"), v.alias("value")) for n, v in enumerate(cases.values())])
    return df.select(key, F.inline(made))


def _part_url(pattern: str):
    """A URL with the part key in place of ``{k}``."""
    head, _, tail = pattern.partition("{k}")
    return F.concat(F.lit(head), F.col("p_partkey").cast("string"), F.lit(tail))


def _sql_values(rows, columns: str) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return str(v).lower() if isinstance(v, (bool, int)) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"


def _on_parts(patterns, *facts: str, out: str) -> str:
    values = _sql_values([(n, *row) for n, row in enumerate(patterns)], ", ".join(("n", "pattern", *facts)))
    return f"SELECT p_partkey, n, {out} FROM part, {values}"


def _part_variants(spark, folder, patterns):
    cases = {row[0]: _part_url(row[0]) for row in patterns}
    return _variants(table(spark, folder, "part"), "p_partkey", cases)


@query(
    "url_parts",
    """SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '//([^/?#]*)', 1) AS host,
    regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query,
    regexp_extract(url, '#(.*)', 1) AS fragment FROM pages""",
)
def url_parts(spark, folder):
    url = F.col("url")
    parts = [U.url_part(url, p).alias(p) for p in ("scheme", "host", "path", "query", "fragment")]
    return given_pages(spark, folder).select("page_id", *parts)


VALIDITY = [
    ("https://a.example.com/{k}", None),
    ("HTTP://a.example.com/x y{k}", None),
    ("ftp://a.example.com/{k}", "scheme is not http or https"),
    ("a.example.com/{k}", "scheme is not http or https"),
    ("https:///{k}", "no host"),
    ("http:{k}", "no host"),
]


@query("url_validity", _on_parts(VALIDITY, "reason", out="reason::VARCHAR AS reason"))
def url_validity(spark, folder):
    good, bad = U.split_valid_urls(_part_variants(spark, folder, VALIDITY), "value")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).drop("value")


PDF_URLS = [
    ("https://a.example.com/{k}.pdf", True, True, True),
    ("https://a.example.com/{k}.PDF", True, True, True),
    ("https://a.example.com/{k}.pdf?v=1", True, True, False),
    ("https://a.example.com/{k}.pdf#p2", True, False, False),
    ("https://a.example.com/{k}.pdf;v=1", True, False, False),
    ("https://a.example.com/{k}?f=x.pdf", False, False, True),
    ("https://a.example.com/{k}.pdf/", False, False, False),
    ("https://a.example.com/{k}", False, False, False),
]


@query(
    "is_pdf_url",
    _on_parts(PDF_URLS, "by_path", "by_digest", "by_follow", out="by_path, by_digest, by_follow"),
)
def is_pdf_url(spark, folder):
    value = F.col("value")
    return _part_variants(spark, folder, PDF_URLS).select(
        "p_partkey",
        "n",
        U.is_pdf_url(value).alias("by_path"),
        U.is_pdf_link_digest(value).alias("by_digest"),
        U.is_pdf_href(value).alias("by_follow"),
    )


VIDEO_URLS = [
    ("https://www.youtube.com/watch?v={k}", True),
    ("http://youtube.com/watch?a=1&v={k}#t", True),
    ("https://m.youtube.com/watch?v={k}", True),
    ("https://www.youtube.com:443/watch?v={k}", False),
    ("https://WWW.youtube.com/watch?v={k}", False),
    ("https://www.youtube.com/watch/?v={k}", False),
    ("https://www.youtube.com/watch?x={k}", False),
    ("https://www.youtube.com/shorts/{k}?v=1", False),
]


@query("is_video_url", _on_parts(VIDEO_URLS, "is_video", out="is_video"))
def is_video_url(spark, folder):
    found = _part_variants(spark, folder, VIDEO_URLS)
    return found.select("p_partkey", "n", U.is_video_url(F.col("value")).alias("is_video"))


FILE_NAMES = [
    ("https://a.example.com/x/{k}.pdf?v=1", "{k}.pdf"),
    ("https://a.example.com/x/{k}.PDF", "{k}.PDF"),
    ("https://a.example.com/x/{k}//", "{k}.pdf"),
    ("{k}?", "{k}.pdf"),
    ("/?q={k}", "downloaded.pdf"),
]


@query(
    "url_filename", _on_parts(FILE_NAMES, "name", out="replace(name, '{k}', p_partkey::VARCHAR) AS name")
)
def url_filename(spark, folder):
    found = _part_variants(spark, folder, FILE_NAMES)
    return found.select("p_partkey", "n", U.url_filename(F.col("value")).alias("name"))


# References, and what each gives on a page URL: {o} is its origin, {f} its folder,
# {g} the folder above, {p} its path, {q} its query with the question mark, {s} its
# scheme, {u} the URL itself; {w} is a question mark unless the scheme is https, since
# a reference in another scheme stays as it is written.
REFERENCES = [
    ("", "{u}"),
    ("x/y.html", "{o}{f}x/y.html"),
    ("./x/../y/.", "{o}{f}y/"),
    ("../x", "{o}{g}x"),
    ("../../../x", "{o}/x"),
    ("/a/./b/../c", "{o}/a/c"),
    ("/a//b", "{o}/a//b"),
    ("?z=1", "{o}{p}?z=1"),
    ("#f", "{o}{p}{q}#f"),
    ("//cdn.example.org/y", "{s}://cdn.example.org/y"),
    ("https://other.example.org/a/../b?", "https://other.example.org/a/../b{w}"),
    ("mailto:a@example.com", "mailto:a@example.com"),
    ("x;p=1?q#f", "{o}{f}x;p=1?q#f"),
]


def _resolved_sql() -> str:
    out = "pattern"
    for name, sql in (
        ("u", "url"),
        ("o", ORIGIN),
        ("f", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1)"),
        ("g", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)[^/?#]*/', 1)"),
        ("p", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"),
        ("q", "regexp_extract(url, '[?][^#]*')"),
        ("s", "regexp_extract(url, '^([a-z]+):', 1)"),
        ("w", "CASE WHEN url LIKE 'https:%' THEN '' ELSE '?' END"),
    ):
        out = f"replace({out}, '{{{name}}}', {sql})"
    values = _sql_values([(n, wanted) for n, (_, wanted) in enumerate(REFERENCES)], "n, pattern")
    return f"SELECT page_id, n, {out} AS resolved FROM pages, {values}"


@query("resolve_url", _resolved_sql())
def resolve_url(spark, folder):
    refs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r).alias("href")) for n, (r, _) in enumerate(REFERENCES)])
    pages = given_pages(spark, folder).select("page_id", U.base_parts(F.col("url")).alias("base"), F.inline(refs))
    return pages.select("page_id", "n", U.resolve_against(F.col("base"), F.col("href")).alias("resolved"))


SPACED = "chr(160) || ' ' || replace(text, ' ', chr(8195) || chr(9)) || chr(12288) || chr(10)"


@query("clean_ws", f"SELECT doc_id, {clean(SPACED)} AS text FROM documents")
def clean_ws(spark, folder):
    spaced = F.concat(
        F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t")), F.lit("　\n")
    )
    return table(spark, folder, "documents").select("doc_id", T.clean_ws(spaced).alias("text"))


@query("clean_cell", f"SELECT doc_id, {strip("replace(chr(9) || text || '  ', chr(10), ' ')")} AS cell FROM documents")
def clean_cell(spark, folder):
    cell = F.concat(F.lit("\t"), "text", F.lit("  "))
    return table(spark, folder, "documents").select("doc_id", T.clean_cell(cell).alias("cell"))


@query(
    "blank_rows",
    """SELECT p_partkey, n_rows, kept FROM part, (VALUES (0, 2, 1), (1, 3, 2)) AS v(n, n_rows, kept)
    WHERE (n = 0) = (p_size <= 25)""",
)
def blank_rows(spark, folder):
    """Rows of grids that vary with the size of a part: kept where a cell is filled."""
    none = F.lit(None).cast("string")
    filled, blank = F.array(none, F.col("p_name")), F.array(none, F.lit(""))
    grid = F.when(F.col("p_size") <= 25, F.array(blank, filled)).otherwise(
        F.array(filled, blank, F.array(F.lit(" ")))
    )
    return table(spark, folder, "part").select(
        "p_partkey", F.size(grid).alias("n_rows"), F.size(drop_blank_rows(grid)).alias("kept")
    )


@query("hash_keys", "SELECT c_custkey, sha256(c_name) AS key_hash FROM customer")
def hash_keys(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", T.hash_key(F.col("c_name")).alias("key_hash"))


@query(
    "output_names",
    """SELECT o_orderkey, 'scraped_links_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.json' AS page_name,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'pdf' ELSE 'r.' || o_orderkey END || '_all_' ||
    strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.md' AS doc_name FROM orders""",
)
def output_names(spark, folder):
    at = F.col("o_orderdate")
    path = F.concat(F.lit("in/d/r."), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    source = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(path)
    page_name = T.output_name(F.lit("scraped"), F.lit("links"), F.lit("json"), at)
    doc_name = T.output_name(T.file_stem(source), F.lit("all"), F.lit("md"), at)
    return table(spark, folder, "orders").select(
        "o_orderkey", page_name.alias("page_name"), doc_name.alias("doc_name")
    )


@query(
    "section_titles",
    """SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) || ' Http Equiv' AS title FROM part""",
)
def section_titles(spark, folder):
    name = F.concat("p_type", F.lit("_http_equiv"))
    return table(spark, folder, "part").select("p_partkey", T.section_title(name).alias("title"))


@query(
    "pdf_validity",
    """SELECT c_custkey, n, valid AS is_valid, CASE WHEN NOT valid THEN 'not a PDF, content type ' || shown END AS reason
    FROM customer, (VALUES (0, true, NULL), (1, true, NULL), (2, false, 'text/html'), (3, false, '?'), (4, false, '?'))
    AS v(n, valid, shown)""",
)
def pdf_validity(spark, folder):
    """Payloads made of customer names: by media type, by magic bytes, and rejects."""
    body = F.col("c_name")
    cases = [
        (F.lit("Application/PDF; q=1"), body),
        (F.lit("application/octet-stream"), F.concat(F.lit("%PDF-1.7\n"), body)),
        (F.lit("Text/HTML"), F.concat(F.lit("<p>%PDF-"), body)),
        (F.lit(None).cast("string"), F.concat(F.lit(" %PDF-"), body)),
        (F.lit(""), F.lit("%PDF")),
    ]
    payloads = F.array(
        *[
            F.struct(F.lit(n).alias("n"), kind.alias("content_type"), data.cast("binary").alias("content"))
            for n, (kind, data) in enumerate(cases)
        ]
    )
    rows = table(spark, folder, "customer").select("c_custkey", F.inline(payloads))
    return pdf.pdf_validity(rows).select("c_custkey", "n", "is_valid", "reason")


@query("pdf_page_count", "SELECT p_partkey, greatest(p_size // 5, 1)::INTEGER AS total_pages FROM part")
def pdf_page_count(spark, folder):
    """Files with a page object per five units of size, and a page tree that does not count."""
    objects = F.repeat(F.lit("<< /Type\n/Page /X>>é"), F.floor(F.col("p_size") / 5).cast("int"))
    raw = F.concat(F.lit("%PDF-1.4 /Type /Pages /Type/PageLabel"), objects)
    files = table(spark, folder, "part").select("p_partkey", F.encode(raw, "ISO-8859-1").alias("content"))
    return pdf.pdf_page_count(files)


@query(
    "job_requests",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN 'https://a.example.com/' || user_id END AS url,
    CASE event_type WHEN 'view' THEN 'links' ELSE 'all' END AS mode, 'json' AS format, '' AS selector,
    event_type = 'click' AS include_meta, false AS no_clean, 'output' AS output_dir FROM events""",
)
def scrape_requests(spark, folder):
    url = F.concat(F.lit("https://a.example.com/"), F.col("user_id").cast("string"))
    mode = F.when(F.col("event_type") == "view", "links")
    meta = F.when(F.col("event_type") == "click", True)
    fields = F.struct(url.alias("url"), mode.alias("mode"), meta.alias("include_meta"))
    payload = F.when(F.col("event_type") == "error", "{not json").otherwise(F.to_json(fields))
    return job_requests(table(spark, folder, "events").select("event_id", payload.alias("payload")))


@query(
    "run_requests_defaults",
    """SELECT event_id, 'https://a.example.com/' || user_id AS url, 'all' AS scrape_mode, 'json' AS scrape_format,
    event_type = 'click' AS follow_pdfs, 'all' AS pdf_op, 'md' AS pdf_format, 'output' AS output_dir,
    value AS delay, NULL::VARCHAR AS ai_prompt FROM events""",
)
def run_requests_defaults(spark, folder):
    url = F.concat(F.lit("https://a.example.com/"), F.col("user_id").cast("string"))
    fields = F.struct(
        url.alias("url"), (F.col("event_type") == "click").alias("follow_pdfs"), F.col("value").alias("delay")
    )
    rows = table(spark, folder, "events").select("event_id", F.to_json(fields).alias("payload"))
    return job_requests(rows, "run")


@query(
    "job_requests_rejected",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'payload: not a JSON object'
      WHEN 'click' THEN 'url: missing'
      ELSE 'follow_pdfs: not a boolean; delay: not a double' END AS reasons
    FROM events WHERE event_type IN ('error', 'click', 'view')""",
)
def job_requests_rejected(spark, folder):
    kind = F.col("event_type")
    url = F.concat(F.lit("https://a.example.com/"), F.col("user_id").cast("string"))
    fields = F.struct(
        F.when(kind != "click", url).alias("url"),
        F.when(kind == "view", "maybe").otherwise("yes").alias("follow_pdfs"),
        F.when(kind == "view", "soon").otherwise(F.col("value").cast("string")).alias("delay"),
    )
    payload = F.when(kind == "error", "{not json").otherwise(F.to_json(fields))
    rows = table(spark, folder, "events").select("event_id", payload.alias("payload"))
    return rejected_requests(rows, "run").select("event_id", F.array_join("reasons", "; ").alias("reasons"))
