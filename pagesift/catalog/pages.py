"""Queries on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.catalog import derived
from pagesift.catalog.registry import query
from pagesift.catalog.sql import INLINE, ORIGIN, PLAIN, clean, escape, no_tags, unescape
from pagesift.operators import extract as X
from pagesift.operators import render
from pagesift.operators.video import video_metadata
from pagesift.plans import runs
from pagesift.plans.scratch import scratch_path
from pagesift.sources import archives
from pagesift.sources.html import read_pages

AT = "2024-05-06T07:08:09"


def given_pages(spark, folder):
    return read_pages(spark, f"{folder}/pages.parquet")


def flat(cells):
    """Nested rows as one string: cells joined by ``|``, rows by ``;``."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "|")), ";")


FOUND_LINKS = f"""found AS (
  SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
         regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts
  FROM plain), links AS (
  SELECT page_id, url, unnest(range(len(hrefs)))::INTEGER AS pos, unnest(hrefs) AS raw_href,
         unnest(texts) AS raw_text
  FROM found), resolved AS (
  SELECT page_id, url, pos, {clean(unescape("raw_text"))} AS text,
         {ORIGIN} || {unescape("raw_href")} AS href
  FROM links)"""
LINKS = f"{PLAIN}, {FOUND_LINKS}"

PARAGRAPHS = f"""{PLAIN}, found AS (
  SELECT page_id, regexp_extract_all(html, '<p>({INLINE})', 1) AS raws FROM plain), raws AS (
  SELECT page_id, raw, n FROM found, unnest(raws) WITH ORDINALITY AS u(raw, n)), cleaned AS (
  SELECT page_id, n, {clean(unescape(no_tags("raw")))} AS content FROM raws), paragraphs AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INTEGER AS pos, content
  FROM cleaned WHERE content <> '')"""

FOUND_BLOCKS = f"""block_lists AS (
  SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li)>{INLINE}') AS raws FROM plain), raws AS (
  SELECT page_id, raw, n FROM block_lists, unnest(raws) WITH ORDINALITY AS u(raw, n)), cleaned AS (
  SELECT page_id, n, regexp_extract(raw, '^<([a-z0-9]+)>', 1) AS tag,
         {clean(unescape(no_tags("raw")))} AS content,
         {clean(unescape(no_tags("raw", " ")))} AS spaced
  FROM raws), blocks AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INTEGER AS pos, tag,
         content, spaced
  FROM cleaned WHERE content <> '')"""
BLOCKS = f"{PLAIN}, {FOUND_BLOCKS}"

BUDGETED = f"""{BLOCKS}, before AS (
  SELECT page_id, pos, spaced AS content,
         coalesce(sum(length(spaced)) OVER (PARTITION BY page_id ORDER BY pos
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM blocks), kept AS (SELECT page_id, pos, content FROM before WHERE used <= 2000)"""

FOUND_TITLES = f"""titles AS (
  SELECT page_id, url, trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title
  FROM plain)"""
TITLES = f"{PLAIN}, {FOUND_TITLES}"


@query("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
def pages_scan(spark, folder):
    return given_pages(spark, folder).select(
        "page_id", "url", F.length("html").cast("bigint").alias("n_chars")
    )


@query(
    "node_counts",
    """WITH plain AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<style>.*?</style>|<!--.*?-->', '', 'gs'),
                                 '<script>.*?</script>', '<script>', 'gs') AS html FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)(?: [^>]*)?>', 1)) AS tag FROM plain)
SELECT page_id, tag, count(*) AS n FROM tags GROUP BY page_id, tag""",
)
def node_counts(spark, folder):
    return X.node_counts(given_pages(spark, folder))


@query("links", f"WITH {LINKS} SELECT page_id, pos, text, href, '' AS title, '' AS rel FROM resolved")
def links(spark, folder):
    return X.links(given_pages(spark, folder)).drop("url")


@query("text_blocks", f"WITH {BLOCKS} SELECT page_id, pos, tag, content FROM blocks")
def text_blocks(spark, folder):
    return X.text_blocks(given_pages(spark, folder)).drop("url")


@query("paragraphs", f"WITH {PARAGRAPHS} SELECT page_id, pos, content FROM paragraphs")
def paragraphs(spark, folder):
    return X.paragraphs(given_pages(spark, folder)).drop("url")


@query("headings", f"WITH {BLOCKS} SELECT page_id, 0 AS pos, content FROM blocks WHERE tag = 'h1'")
def headings(spark, folder):
    return X.headings(given_pages(spark, folder)).drop("url")


@query("titles", f"WITH {TITLES} SELECT page_id, title FROM titles")
def titles(spark, folder):
    return X.page_titles(given_pages(spark, folder)).drop("url")


IMAGES = """SELECT p_partkey AS page_id, pos, 'https://shop.example.com' || src AS src, alt, title, width, height
FROM (SELECT p_partkey, 0 AS pos, '/img/' || p_partkey || '.jpg' AS src, p_name AS alt, '' AS title,
             p_size::VARCHAR AS width, '' AS height FROM part
      UNION ALL
      SELECT p_partkey, 1, '/c/' || p_partkey || '/thumb/' || p_partkey || '.png', '', p_type, '',
             p_size::VARCHAR FROM part)"""


@query("images", IMAGES)
def images(spark, folder):
    return X.images(derived.image_pages(spark, folder)).drop("url")


TABLES = """tables AS (
  SELECT c_custkey AS page_id, 0 AS table_index, c_mktsegment AS caption, true AS has_header,
         [['key', 'name'], [c_custkey::VARCHAR, c_name]] AS rows FROM customer
  UNION ALL
  SELECT c_custkey, 2, '', false, [[c_acctbal::VARCHAR, 'n' || c_nationkey, 'n' || c_nationkey],
                                   ['n' || c_nationkey]] FROM customer
  UNION ALL
  SELECT c_custkey, 3, '', false, [['n' || c_nationkey]] FROM customer)"""


@query(
    "html_tables",
    f"""WITH {TABLES} SELECT page_id, table_index, caption, has_header, len(rows)::INTEGER AS n_rows,
    array_to_string([array_to_string(r, '|') for r in rows], ';') AS cells FROM tables""",
)
def html_tables(spark, folder):
    tables = X.html_tables(derived.table_pages(spark, folder))
    return tables.select(
        "page_id", "table_index", "caption", "has_header", F.size("rows").alias("n_rows"),
        flat("rows").alias("cells"),
    )


@query(
    "html_table_cells",
    f"""WITH {TABLES} SELECT page_id, table_index, (row_no - 1)::INTEGER AS row_index,
    (col_no - 1)::INTEGER AS col_index, content
    FROM tables, unnest(rows) WITH ORDINALITY AS r(cells, row_no),
         unnest(cells) WITH ORDINALITY AS c(content, col_no)""",
)
def html_table_cells(spark, folder):
    return X.html_table_cells(derived.table_pages(spark, folder)).drop("url")


@query(
    "meta_tags",
    """SELECT c_custkey AS page_id, pos, name, property, content, http_equiv, charset FROM customer,
  LATERAL (VALUES (0, '', '', '', '', 'utf-8'),
          (1, 'description', '', ' ' || c_mktsegment || ' & more ', '', ''),
          (2, '', 'og:title', c_name, '', ''),
          (3, '', '', c_nationkey::VARCHAR, 'refresh', ''))
  AS m(pos, name, property, content, http_equiv, charset)""",
)
def meta_tags(spark, folder):
    return X.meta_tags(derived.meta_pages(spark, folder)).drop("url")


@query(
    "meta_tags_given",
    "SELECT page_id, 0 AS pos, '' AS name, '' AS property, '' AS content, '' AS http_equiv, 'utf-8' AS charset FROM pages",
)
def meta_tags_given(spark, folder):
    return X.meta_tags(given_pages(spark, folder)).drop("url")


@query(
    "select_h1_h2",
    f"""WITH {BLOCKS} SELECT page_id, 0 AS index, tag, content,
    substr('<h1>' || {escape("raw")} || '</h1>', 1, 500) AS html
    FROM blocks JOIN (SELECT page_id, {unescape("regexp_extract(html, '<h1>([^<]*)', 1)")} AS raw FROM plain)
    USING (page_id) WHERE tag = 'h1'""",
)
def select_h1_h2(spark, folder):
    return X.select(given_pages(spark, folder), "h1, h2").drop("url")


@query(
    "select_descendant",
    f"""WITH {LINKS} SELECT page_id, pos AS index, 'a' AS tag, text AS content,
    '<a href="' || {escape("raw_href")} || '">' || {escape(unescape("raw_text"))} || '</a>' AS html
    FROM resolved JOIN links USING (page_id, pos)""",
)
def select_descendant(spark, folder):
    return X.select(given_pages(spark, folder), 'nav li > a[href^="/"]').drop("url")


@query(
    "select_positions",
    f"""WITH {LINKS}, numbered AS (
    SELECT *, max(pos) OVER (PARTITION BY page_id) AS last_pos FROM resolved)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS index,
           'li' AS tag, text AS content
    FROM numbered WHERE pos = 1 OR pos = last_pos""",
)
def select_positions(spark, folder):
    hits = X.select(given_pages(spark, folder), "ul > li:nth-child(2), nav li:last-child")
    return hits.select("page_id", "index", "tag", "content")


def _later_items(which: str) -> str:
    return f"""WITH {LINKS} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS index,
    'li' AS tag, text AS content FROM resolved WHERE {which}"""


@query("select_siblings", _later_items("pos >= 2"))
def select_siblings(spark, folder):
    hits = X.select(given_pages(spark, folder), "li + li ~ li, li ~ li + li")
    return hits.select("page_id", "index", "tag", "content")


@query("select_not", _later_items("pos >= 1"))
def select_not(spark, folder):
    hits = X.select(given_pages(spark, folder), "nav li:not(:first-child)")
    return hits.select("page_id", "index", "tag", "content")


@query(
    "page_record_counts",
    f"""WITH {BLOCKS}, l AS (SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links FROM plain)
    SELECT page_id, count_if(tag = 'h1')::BIGINT AS n_headings, count_if(tag = 'p')::BIGINT AS n_paragraphs,
           any_value(n_links)::BIGINT AS n_links, 0::BIGINT AS n_images, 0::BIGINT AS n_tables
    FROM blocks JOIN l USING (page_id) GROUP BY page_id""",
)
def page_record_counts(spark, folder):
    sizes = [
        F.size(s).cast("bigint").alias(f"n_{s}")
        for s in ("headings", "paragraphs", "links", "images", "tables")
    ]
    return X.page_record(given_pages(spark, folder)).select("page_id", *sizes)


@query(
    "section_counts",
    f"""WITH {BLOCKS} SELECT 'headings' AS section, count_if(tag = 'h1')::BIGINT AS n FROM blocks
    UNION ALL SELECT 'paragraphs', count_if(tag = 'p')::BIGINT FROM blocks
    UNION ALL SELECT 'links', sum(len(regexp_extract_all(html, '<a href=')))::BIGINT FROM plain
    UNION ALL SELECT 'images', 0 UNION ALL SELECT 'tables', 0
    UNION ALL SELECT 'meta', count(*) FROM plain""",
)
def section_counts(spark, folder):
    return X.section_counts(X.page_record(given_pages(spark, folder), include_meta=True))


@query("budgeted_text", f"WITH {BUDGETED} SELECT page_id, pos, content FROM kept")
def budgeted_text(spark, folder):
    return X.budgeted_text(given_pages(spark, folder)).drop("url")


@query(
    "page_digest",
    f"""WITH {BUDGETED}, main AS (
    SELECT page_id, string_agg(content, chr(10) ORDER BY pos) AS main_text FROM kept GROUP BY page_id)
    SELECT p.page_id, p.url,
           trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS title,
           '' AS description, coalesce(main_text, '') AS main_text, 0 AS n_pdf_links
    FROM plain p LEFT JOIN main USING (page_id)""",
)
def page_digest(spark, folder):
    digest = X.page_digest(given_pages(spark, folder))
    return digest.withColumn("n_pdf_links", F.size("pdf_links")).drop("pdf_links")


@query(
    "page_digest_description",
    """SELECT c_custkey AS page_id, c_name AS title, c_mktsegment || ' & more' AS description,
    c_mktsegment AS main_text FROM customer""",
)
def page_digest_description(spark, folder):
    digest = X.page_digest(derived.meta_pages(spark, folder))
    return digest.select("page_id", "title", "description", "main_text")


# Links of ``derived.pdf_link_pages``, with what each of the PDF rules says of them.
PDF_LINKS = """all_links AS (
  SELECT p_partkey AS page_id, pos, 'https://docs.example.com' || path AS href, follow, digest FROM part,
  LATERAL (VALUES (0, '/d/' || p_partkey || '.pdf', true, true),
          (1, '/d/' || p_partkey || '.PDF', true, true),
          (2, '/s/' || p_partkey || '/d/' || p_partkey || '.pdf?v=1', false, true),
          (3, '/d/' || p_partkey || '.pdf#p', false, false),
          (7, '/d/' || p_partkey || '.pdf', true, true),
          (8, '/d/0.pdf', true, true)) AS l(pos, path, follow, digest)),
follow_links AS (SELECT page_id, pos, href FROM all_links WHERE follow),
landed AS (SELECT p_partkey AS doc_id, 'https://docs.example.com/d/' || p_partkey || '.pdf' AS href
           FROM part WHERE p_size <= 25 OR p_partkey = 0)"""


@query("pdf_links", f"WITH {PDF_LINKS} SELECT page_id, pos, href FROM follow_links")
def pdf_links(spark, folder):
    found = runs.pdf_links(X.links(derived.pdf_link_pages(spark, folder)))
    return found.select("page_id", "pos", "href")


@query(
    "distinct_pdf_links",
    f"""WITH {PDF_LINKS}, firsts AS (
    SELECT page_id, href, min(pos) AS pos FROM all_links WHERE digest GROUP BY page_id, href)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::INTEGER AS pos, href
    FROM firsts""",
)
def distinct_pdf_links(spark, folder):
    digest = X.page_digest(derived.pdf_link_pages(spark, folder))
    found = digest.select("page_id", F.posexplode_outer("pdf_links").alias("pos", "href"))
    return found.filter("pos is not null")


@query(
    "video_metadata",
    """SELECT o_orderkey AS page_id, 'youtube' AS platform,
    'https://' || CASE o_orderstatus WHEN 'P' THEN 'm' ELSE 'www' END || '.youtube.com/watch?v=' || o_orderkey AS url,
    'v' || o_orderkey AS video_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Og ' ELSE 'Order ' END || o_orderkey AS title,
    'c' || o_custkey AS channel, 'a {b} & "c"' AS short_description,
    CASE o_orderstatus WHEN 'O' THEN 0 ELSE o_custkey END AS duration_seconds,
    o_orderkey AS view_count, strftime(o_orderdate, '%Y-%m-%d') AS publish_date, o_orderpriority AS category,
    CASE o_orderpriority WHEN '2-HIGH' THEN '' ELSE '/t' || o_orderkey || '.jpg' END AS thumbnail,
    o_orderstatus = 'F' AS is_live
    FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def video_facts(spark, folder):
    return video_metadata(derived.video_pages(spark, folder))


@query(
    "essential_kinds",
    """SELECT o_orderkey AS page_id, o_orderpriority <> '5-LOW' AS is_video,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'x' END AS main_text FROM orders""",
)
def essential_kinds(spark, folder):
    both = X.extract(derived.video_pages(spark, folder), "essential")
    return both.select(
        "page_id", F.col("video").isNotNull().alias("is_video"), F.col("digest.main_text").alias("main_text")
    )


@query(
    "links_text_lines",
    f"""WITH {LINKS} SELECT page_id, '# Scraped: ' || url || chr(10) || '# Mode: links' || chr(10) ||
    '# At: {AT}' || chr(10) || chr(10) ||
    string_agg('[' || pos || '] ' || CASE WHEN text = '' THEN href ELSE text END, chr(10) ORDER BY pos) AS body
    FROM resolved GROUP BY page_id, url""",
)
def links_text_lines(spark, folder):
    found = X.extract(given_pages(spark, folder), "links")
    return render.page_txt(found, "links", AT).drop("url")


MD_HEAD = """'# Scraped Data' || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || chr(10) ||
    '| URL | `' || url || '` |' || chr(10) || '| Mode | `{mode}` |' || chr(10) ||
    '| Scraped at | `{at}` |' || chr(10) || chr(10)"""


def md_cut(x: str) -> str:
    return f"substr(replace({x}, '|', chr(92) || '|'), 1, 120)"


@query(
    "links_markdown",
    f"""WITH {LINKS} SELECT page_id, {MD_HEAD.format(mode="links", at=AT)} ||
    '| text | href | title | rel |' || chr(10) || '|---|---|---|---|' || chr(10) ||
    string_agg('| ' || {md_cut("text")} || ' | ' || {md_cut("href")} || ' |  |  |', chr(10) ORDER BY pos) AS body
    FROM resolved GROUP BY page_id, url""",
)
def links_markdown(spark, folder):
    found = X.extract(given_pages(spark, folder), "links")
    return render.page_md(found, "links", AT).drop("url")


@query(
    "pages_packed",
    f"""WITH {LINKS} SELECT page_id || '/scraped_links_20240506_070809.md' AS file,
    {MD_HEAD.format(mode="links", at="2024-05-06T07:08:09")} ||
    '| text | href | title | rel |' || chr(10) || '|---|---|---|---|' || chr(10) ||
    string_agg('| ' || {md_cut("text")} || ' | ' || {md_cut("href")} || ' |  |  |', chr(10) ORDER BY pos) AS body
    FROM resolved GROUP BY page_id, url""",
)
def pages_packed(spark, folder):
    """Extracted, rendered and packed in one go, and read back by name."""
    out = scratch_path(spark, "page-archives")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    runs.extract_and_pack(given_pages(spark, folder), "links", "md", out, at)
    return archives.texts_of(archives.read_archives(spark, out))


@query(
    "page_markdown",
    f"""WITH {LINKS}, {FOUND_BLOCKS},
    l AS (SELECT page_id, string_agg('| ' || {md_cut("text")} || ' | ' || {md_cut("href")} || ' |  |  |',
                                     chr(10) ORDER BY pos) AS lines FROM resolved GROUP BY page_id),
    h AS (SELECT page_id, string_agg('- ' || content, chr(10) ORDER BY pos) AS lines
          FROM blocks WHERE tag = 'h1' GROUP BY page_id),
    p AS (SELECT page_id, string_agg('- ' || content, chr(10) ORDER BY pos) AS lines
          FROM blocks WHERE tag = 'p' GROUP BY page_id)
    SELECT plain.page_id, {MD_HEAD.format(mode="all", at=AT)} ||
    '## Title' || chr(10) || trim({unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) || chr(10) || chr(10) ||
    '## Headings' || chr(10) || coalesce(h.lines, '_(empty)_') || chr(10) || chr(10) ||
    '## Paragraphs' || chr(10) || coalesce(p.lines, '_(empty)_') || chr(10) || chr(10) ||
    '## Links' || chr(10) || coalesce('| text | href | title | rel |' || chr(10) || '|---|---|---|---|' || chr(10)
                                     || l.lines, '_(empty)_') || chr(10) || chr(10) ||
    '## Images' || chr(10) || '_(empty)_' || chr(10) || chr(10) ||
    '## Tables' || chr(10) || '_(empty)_' || chr(10) AS body
    FROM plain LEFT JOIN l USING (page_id) LEFT JOIN h USING (page_id) LEFT JOIN p USING (page_id)""",
)
def page_markdown(spark, folder):
    return render.page_md(X.page_record(given_pages(spark, folder)), "all", AT).drop("url")


@query(
    "page_text_sections",
    f"""WITH {TABLES}, rows_json AS (
    SELECT page_id, string_agg('  table_index: ' || table_index || '  |  caption: ' || caption ||
      '  |  has_header: ' || CASE WHEN has_header THEN 'True' ELSE 'False' END || '  |  rows: ' ||
      to_json(rows)::VARCHAR, chr(10) ORDER BY table_index) AS lines FROM tables GROUP BY page_id)
    SELECT page_id, '# Scraped: https://shop.example.com/t/' || page_id || chr(10) || '# Mode: all' || chr(10) ||
    '# At: {AT}' || chr(10) || chr(10) || '--- TITLE ---' || chr(10) || '  ' || chr(10) || chr(10) ||
    '--- HEADINGS ---' || chr(10) || chr(10) || '--- PARAGRAPHS ---' || chr(10) || chr(10) ||
    '--- LINKS ---' || chr(10) || chr(10) || '--- IMAGES ---' || chr(10) || chr(10) ||
    '--- TABLES ---' || chr(10) || lines || chr(10) AS body FROM rows_json""",
)
def page_text_sections(spark, folder):
    records = X.page_record(derived.table_pages(spark, folder))
    return render.page_txt(records, "all", AT).drop("url")


@query(
    "page_json",
    f"""WITH {LINKS} SELECT page_id, url AS meta_url, 'links' AS meta_mode, '{AT}' AS meta_at,
    count(*)::INTEGER AS n_items, arg_min(text, pos) AS first_text, arg_max(href, pos) AS last_href
    FROM resolved GROUP BY page_id, url""",
)
def page_json(spark, folder):
    """The JSON bodies, read back: key order and escapes are not part of the format."""
    bodies = render.page_json(X.extract(given_pages(spark, folder), "links"), "links", AT)
    shape = (
        "metadata struct<url: string, mode: string, scraped_at: string>, "
        "data array<struct<text: string, href: string>>"
    )
    back = bodies.select("page_id", F.from_json("body", shape).alias("b")).filter("size(b.data) > 0")
    return back.select(
        "page_id",
        F.col("b.metadata.url").alias("meta_url"),
        F.col("b.metadata.mode").alias("meta_mode"),
        F.col("b.metadata.scraped_at").alias("meta_at"),
        F.size("b.data").alias("n_items"),
        F.get("b.data", F.lit(0))["text"].alias("first_text"),
        F.element_at("b.data", -1)["href"].alias("last_href"),
    )


@query(
    "flatten_sections",
    f"""WITH {LINKS}, {FOUND_TITLES}, {FOUND_BLOCKS}, headed AS (
    SELECT page_id, CASE tag WHEN 'h1' THEN 'headings' ELSE 'paragraphs' END AS section, content,
           (row_number() OVER (PARTITION BY page_id, tag ORDER BY pos) - 1)::INTEGER AS pos
    FROM blocks WHERE tag IN ('h1', 'p'))
    SELECT page_id, 'title' AS section, 0 AS pos, title AS value, NULL::VARCHAR AS text, NULL::VARCHAR AS href,
           NULL::VARCHAR AS charset FROM titles
    UNION ALL SELECT page_id, section, pos, content, NULL, NULL, NULL FROM headed
    UNION ALL SELECT page_id, 'links', pos, NULL, text, href, NULL FROM resolved
    UNION ALL SELECT page_id, 'meta', 0, NULL, NULL, NULL, 'utf-8' FROM pages""",
)
def flatten_sections(spark, folder):
    rows = render.flatten_sections(X.page_record(given_pages(spark, folder), include_meta=True))
    return rows.select("page_id", "section", "pos", "value", "text", "href", "charset")


@query(
    "flatten_sections_images",
    f"""SELECT page_id, 'images' AS section, pos, NULL::VARCHAR AS value, title, src, alt, width, height
    FROM ({IMAGES})
    UNION ALL SELECT p_partkey, 'title', 0, '', NULL, NULL, NULL, NULL, NULL FROM part
    UNION ALL SELECT p_partkey, 'headings', 0, p_name, NULL, NULL, NULL, NULL, NULL FROM part""",
)
def flatten_sections_images(spark, folder):
    rows = render.flatten_sections(X.page_record(derived.image_pages(spark, folder)))
    return rows.select("page_id", "section", "pos", "value", "title", "src", "alt", "width", "height")
