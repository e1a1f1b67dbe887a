"""Queries on following links, runs and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.catalog import derived
from pagesift.catalog.documents import FULL_TEXT
from pagesift.catalog.history import LATEST
from pagesift.catalog.pages import LINKS, PDF_LINKS
from pagesift.catalog.registry import query
from pagesift.catalog.sql import NL
from pagesift.operators import extract as X
from pagesift.operators.paged import full_text_of
from pagesift.plans import jobtable, runs
from pagesift.plans.scratch import scratch_path, written
from pagesift.sources import archives, pdf
from pagesift.sources.html import PAGE_SCHEMA
from pagesift.streaming import feeds

STAMP = "20240506_070809"


def _at():
    return F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")


def _links(spark, folder):
    found = runs.pdf_links(X.links(derived.pdf_link_pages(spark, folder)))
    return found.select("page_id", "pos", "href")


@query(
    "followed_docs",
    f"WITH {PDF_LINKS} SELECT page_id, pos, href, doc_id FROM follow_links JOIN landed USING (href)",
)
def followed_docs(spark, folder):
    return runs.follow_links(_links(spark, folder), derived.linked_documents(spark, folder))


@query(
    "unresolved_links",
    f"WITH {PDF_LINKS} SELECT page_id, pos, href FROM follow_links WHERE href NOT IN (SELECT href FROM landed)",
)
def unresolved_links(spark, folder):
    return runs.unresolved_links(_links(spark, folder), derived.linked_documents(spark, folder))


@query(
    "followed_docs_split",
    f"WITH {PDF_LINKS} SELECT page_id, pos, href, doc_id FROM follow_links JOIN landed USING (href)",
)
def followed_docs_split(spark, folder):
    """The shared document is a hot target: every page links to it. It is dealt out over
    tasks; the links are written first because the join reads them twice."""
    links = written(_links(spark, folder), "links")
    targets = runs.landed_urls(derived.linked_documents(spark, folder)).withColumnRenamed("url", "href")
    return runs.split_hot_keys_join(links, targets, "href", "inner", splits=8, hot_rows=100)


# The requests of ``derived.run_requests_table`` and the work each of them asks for.
REQUESTS = f"""{PDF_LINKS}, requests AS (
  SELECT p_partkey AS request_id,
    CASE p_size WHEN 20 THEN 'https://docs.example.com/d/' || p_partkey || '.pdf?x=1'
                WHEN 21 THEN 'https://docs.example.com/d/' || p_partkey || '.pdf'
                WHEN 22 THEN 'https://docs.example.com/gone/' || p_partkey
                ELSE 'https://docs.example.com/s/' || p_partkey || '/index.html' END AS url,
    CASE WHEN p_type = 'ECONOMY' THEN 'links' WHEN p_size > 45 THEN 'custom' WHEN p_size < 5 THEN 'text'
         ELSE 'all' END AS mode,
    p_size <> 30 AS follow, p_size FROM part), work AS (
  SELECT request_id, 0 AS pos, url AS target, 'direct' AS source FROM requests WHERE p_size IN (20, 21)
  UNION ALL
  SELECT request_id, (row_number() OVER (PARTITION BY request_id ORDER BY l.pos) - 1)::INTEGER, href, 'followed'
  FROM requests JOIN follow_links l ON l.page_id = request_id
  WHERE follow AND mode IN ('all', 'links') AND p_size NOT IN (20, 21, 22)), outputs AS (
  SELECT request_id, -1 AS seq, 'scrape' AS type, request_id || '/scraped_' || mode || '_{STAMP}.json' AS file, url AS source
  FROM requests WHERE mode <> 'custom' AND p_size NOT IN (20, 21, 22)
  UNION ALL
  SELECT request_id, pos, 'pdf', request_id || '/pdf/' || pos || '_' || regexp_extract(target, '([0-9]+)[.](?:pdf|PDF)', 1) || '_all_{STAMP}.md', target
  FROM work WHERE target IN (SELECT href FROM landed)), failed AS (
  SELECT request_id, CASE WHEN mode = 'custom' THEN 'scrape: CSS selector required for mode=''custom'''
                          ELSE 'scrape: page not found' END AS error
  FROM requests WHERE mode = 'custom' OR p_size IN (20, 21, 22))"""

MANIFEST = f"""WITH {REQUESTS} SELECT r.request_id, r.url,
  coalesce((SELECT string_agg(type || ' ' || file || ' ' || source, ';' ORDER BY seq) FROM outputs o
            WHERE o.request_id = r.request_id), '') AS outputs, coalesce(error, '') AS errors
  FROM requests r LEFT JOIN failed USING (request_id)"""


def _flat_manifest(manifest):
    outputs = F.transform("outputs", lambda o: F.concat_ws(" ", o["type"], o["file"], o["source"]))
    return manifest.select(
        "request_id", "url", F.array_join(outputs, ";").alias("outputs"), F.array_join("errors", ";").alias("errors")
    )


@query("pdf_worklist", f"WITH {REQUESTS} SELECT request_id, pos, target, source FROM work")
def pdf_worklist(spark, folder):
    work = runs.pdf_worklist(
        derived.run_requests_table(spark, folder), derived.pdf_link_pages(spark, folder)
    )
    return work.select("request_id", "pos", "target", "source")


@query("run_manifest", MANIFEST)
def run_manifest(spark, folder):
    manifest = runs.run_requests(
        derived.run_requests_table(spark, folder),
        derived.pdf_link_pages(spark, folder),
        derived.linked_documents(spark, folder),
        _at(),
    )
    return _flat_manifest(manifest)


# What the files of the requests hold. Every page has the same items in mode ``text``.
_ITEMS = ("first", "upper", "query", "fragment", "page", "mail", "script", "self", "anchor", "again", "shared")
_ITEMS_JSON = ",".join(f'{{"tag":"li","content":"{item}"}}' for item in _ITEMS)
_TIME = "2024-05-06T07:08:09"
FILES = f"""WITH {REQUESTS}, page_links AS (
  SELECT p_partkey AS request_id, pos, content, href FROM part, LATERAL (VALUES
    (0, 'first', '/d/' || p_partkey || '.pdf'), (1, 'upper', '/d/' || p_partkey || '.PDF'),
    (2, 'query', '/s/' || p_partkey || '/d/' || p_partkey || '.pdf?v=1'), (3, 'fragment', '/d/' || p_partkey || '.pdf#p'),
    (4, 'page', '/s/' || p_partkey || '.html'), (5, 'mail', NULL), (6, 'self', '/s/' || p_partkey || '/index.html'),
    (7, 'again', '/d/' || p_partkey || '.pdf'), (8, 'shared', '/d/0.pdf')) AS l(pos, content, path),
    LATERAL (SELECT coalesce('https://docs.example.com' || path, 'mailto:a@example.com')) AS h(href)),
  listed AS (
    SELECT request_id, string_agg(content || ',' || href || ',,', {NL} ORDER BY pos) AS csv,
      string_agg('  text: ' || content || '  |  href: ' || href || '  |  title:   |  rel: ', {NL} ORDER BY pos) AS txt
    FROM page_links GROUP BY request_id),
  names AS (SELECT 'https://docs.example.com/d/' || p_partkey || '.pdf' AS source, p_name FROM part)
SELECT o.request_id, o.seq, type, replace(file, '_{STAMP}.json', '_{STAMP}.' || CASE mode WHEN 'links' THEN 'csv'
    WHEN 'all' THEN 'txt' ELSE 'json' END) AS file, source,
  CASE WHEN type = 'pdf' THEN array_to_string(['# PDF Processing Report', '', '| Field | Value |', '|---|---|',
      '| Source | `' || source || '` |', '| Operation | `all` |', '| Pages | `all` |', '| Generated | `{_TIME}` |', '',
      '## AI Summary', '', 'SIZE ' || p_size % 3, '', '## Extracted Text', '', '### Page 1', '', p_name, ''], {NL})
    WHEN mode = 'links' THEN 'text,href,title,rel' || {NL} || csv
    WHEN mode = 'all' THEN array_to_string(['# Scraped: ' || source, '# Mode: all', '# At: {_TIME}', '', '--- TITLE ---', '  ', '',
      '--- HEADINGS ---', '', '--- PARAGRAPHS ---', '', '--- LINKS ---', txt, '', '--- IMAGES ---', '', '--- TABLES ---', ''], {NL})
    ELSE '{{"metadata":{{"url":"' || source || '","mode":"text","scraped_at":"{_TIME}"}},"data":[{_ITEMS_JSON}]}}' END AS body
FROM outputs o JOIN requests USING (request_id) JOIN listed USING (request_id) LEFT JOIN names USING (source)"""


def _file_requests(spark, folder):
    """Requests in several formats, with prompts."""
    mode, asked = F.col("scrape_mode"), derived.run_requests_table(spark, folder)
    sizes = derived.table(spark, folder, "part").select(F.col("p_partkey").alias("request_id"), "p_size")
    prompt = F.concat(F.lit("Size "), (F.col("p_size") % 3).cast("string"))
    fmt = F.when(mode == "links", "csv").when(mode == "all", "txt").otherwise("json")
    asked = asked.withColumn("scrape_format", fmt).join(sizes, "request_id")
    return asked.withColumn("ai_prompt", prompt).drop("p_size")


def _upper_instruction(prompt: str) -> str:
    return prompt.split("\n")[0].upper()


@query("run_files", FILES)
def run_files(spark, folder):
    """The files of all runs, written as a table and read back."""
    out = scratch_path(spark, "run-files")
    runs.write_run(
        _file_requests(spark, folder),
        derived.pdf_link_pages(spark, folder),
        derived.landed_documents(spark, folder),
        _at(),
        out,
        fn=_upper_instruction,
    )
    return spark.read.parquet(out)


@query("files_written", f"SELECT file, body FROM ({FILES}) AS files")
def files_written(spark, folder):
    """The files of all runs, packed under their names and read back by name."""
    out = scratch_path(spark, "archives")
    runs.write_run_archives(
        _file_requests(spark, folder),
        derived.pdf_link_pages(spark, folder),
        derived.landed_documents(spark, folder),
        _at(),
        out,
        most=100_000,
        fn=_upper_instruction,
    )
    return archives.texts_of(archives.read_archives(spark, out))


@query(
    "pdf_files",
    r"""WITH files AS (
      SELECT s_nationkey AS nation, s_suppkey, ['.pdf', '.PDF', '.Pdf', '.txt'][s_suppkey % 4 + 1] AS suffix, s_suppkey % 5 <> 0 AS good,
             CASE WHEN good THEN '%PDF-1.4' || chr(10) || repeat('<< /Type /Page >>' || chr(10), s_suppkey % 3) || '/Type /Pages ' || s_name
                  ELSE 'no file ' || s_name END AS content FROM supplier)
    SELECT nation::INTEGER AS nation, s_suppkey || suffix AS file, strlen(content)::BIGINT AS length, good AS is_valid,
           CASE WHEN NOT good THEN 'not a PDF, content type ?' END AS reason,
           CASE WHEN good THEN greatest(s_suppkey % 3, 1)::INTEGER END AS total_pages
    FROM files WHERE suffix <> '.txt'""",
)
def pdf_files(spark, folder):
    """Files of a supplier each, written as such in a folder per nation and scanned."""
    out = scratch_path(spark, "pdfs")
    archives.write_files(derived.pdf_payloads(spark, folder), out)
    found = pdf.pdf_validity(pdf.read_pdf_files(spark, out).withColumn("content_type", F.lit(None).cast("string")))
    return found.select(
        F.col("nation").cast("int").alias("nation"),
        F.regexp_extract("path", "[^/]+$", 0).alias("file"),
        "length",
        "is_valid",
        "reason",
        F.when(F.col("is_valid"), pdf.page_count(F.col("content"))).alias("total_pages"),
    )


# -- feeds: run to the end of what has arrived, then read what they wrote ----------------


def _places(spark, name):
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")


def _landed_feed(spark, folder, name, df):
    """Derived rows as files that a feed can pick up."""
    landed = written(df, name)
    return feeds.read_feed(spark, landed.inputFiles()[0].rsplit("/", 1)[0], landed.schema, 3)


@query("stream_links", f"WITH {LINKS} SELECT page_id, pos, text, href FROM resolved")
def stream_links(spark, folder):
    out, checkpoint = _places(spark, "links")
    feed = feeds.read_feed(spark, f"{folder}/pages*.parquet", PAGE_SCHEMA)
    feeds.stream_extract(feed, "links", out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("page_id", "pos", "text", "href")


@query("stream_doc_text", f"WITH {FULL_TEXT} SELECT doc_id, full_text FROM full_texts")
def stream_doc_text(spark, folder):
    out, checkpoint = _places(spark, "docs")
    feed = _landed_feed(spark, folder, "docs-in", derived.paged_documents(spark, folder))
    feeds.stream_docs(feed, "extract", out, checkpoint).awaitTermination()
    done = spark.read.parquet(out)
    return done.select("doc_id", full_text_of(F.col("text_pages")).alias("full_text"))


@query("stream_manifest", MANIFEST)
def stream_manifest(spark, folder):
    out, checkpoint = _places(spark, "manifest")
    feed = _landed_feed(spark, folder, "requests-in", derived.run_requests_table(spark, folder))
    pages = derived.pdf_link_pages(spark, folder)
    feeds.stream_runs(
        feed,
        pages,
        derived.linked_documents(spark, folder),
        _at(),
        out,
        checkpoint,
        links=written(runs.page_pdf_links(pages), "page-links"),
    ).awaitTermination()
    return _flat_manifest(spark.read.parquet(out))


@query(
    "stream_late_pages",
    """SELECT p_partkey AS request_id, CASE WHEN p_size < 30 THEN p_partkey END AS page_id,
    CASE WHEN p_size >= 30 THEN 'scrape: page not found' END AS error FROM part""",
)
def stream_late_pages(spark, folder):
    """A request and a page per part. Pages land an hour before, five minutes after or an hour
    after they are asked for, or never; requests wait for ten minutes. Both come in the order of
    time, half an hour after the other; a last page and a last request move the time on."""
    out, checkpoint = _places(spark, "late-pages")
    places = {name: scratch_path(spark, f"late-{name}") for name in ("requests", "pages")}
    size, parts = F.col("p_size"), derived.table(spark, folder, "part")
    start = F.lit("2024-05-06 00:00:00").cast("timestamp")
    asked_at = F.timestamp_add("SECOND", (F.col("p_partkey") % 3600).cast("int"), start)
    wait = F.when(size < 15, -3600).when(size < 30, 300).otherwise(3600)
    url = F.concat(F.lit("https://p.example.com/"), "p_partkey")
    asked = parts.select(F.col("p_partkey").alias("request_id"), url.alias("url"), asked_at.alias("asked_at"))
    landed = parts.filter(size < 45).select(
        F.col("p_partkey").alias("page_id"), url.alias("url"), F.timestamp_add("SECOND", wait, asked_at).alias("landed_at")
    )
    day_after = F.timestamp_add("DAY", F.lit(2), start)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit("end").alias("url"), day_after.alias("at"))
    asked, landed = asked.union(end), landed.union(end)
    bounds = [-100_000, 0, 30, 60, 1000, 100_000]
    for low, high in zip(bounds, bounds[1:], strict=False):
        low, high = (F.timestamp_add("MINUTE", F.lit(minutes), start) for minutes in (low, high))
        for name, rows, at in (("requests", asked, "asked_at"), ("pages", landed, "landed_at")):
            rows.filter((F.col(at) >= low) & (F.col(at) < high)).write.mode("append").parquet(places[name])
        requests, pages = (
            feeds.read_feed(spark, places[name], rows.schema, 1_000_000) for name, rows in (("requests", asked), ("pages", landed))
        )
        answered = feeds.stream_awaited_pages(requests, pages, "10 minutes", "2 hours")
        feeds.append(answered, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).filter("request_id >= 0").select("request_id", "page_id", "error")


@query("stream_run_files", FILES)
def stream_run_files(spark, folder):
    out, checkpoint = _places(spark, "files")
    feed = _landed_feed(spark, folder, "file-requests-in", _file_requests(spark, folder))
    pages = derived.pdf_link_pages(spark, folder)
    docs = written(derived.landed_documents(spark, folder), "landed-docs")
    links = written(runs.page_pdf_links(pages), "page-links")
    feeds.stream_run_bodies(
        feed, pages, docs, _at(), out, checkpoint, links=links, fn=_upper_instruction
    ).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


@query("stream_job_latest", f"WITH {LATEST} SELECT job_id, ts, event_id AS seq, event_type AS status FROM latest")
def stream_job_latest(spark, folder):
    out, checkpoint = _places(spark, "jobs")
    feed = _landed_feed(spark, folder, "changes-in", derived.job_events(spark, folder))
    feeds.stream_job_changes(feed, out, checkpoint).awaitTermination()
    return feeds.current_jobs(spark, out).select("job_id", "ts", "seq", "status")


@query(
    "stream_job_table",
    """WITH changes AS (
      SELECT user_id AS job_id, (ts, event_id) AS t, event_type IN ('signup', 'purchase') AS is_new, * FROM events),
    inserts AS (SELECT job_id, max(t) AS t, min(ts) AS created_at, arg_max(event_type, t) AS status, arg_max(props, t) AS request,
                       arg_max(ts, t) AS at, arg_max(event_id, t) AS seq
                FROM changes WHERE is_new GROUP BY job_id),
    updates AS (SELECT c.job_id, arg_max(event_type, c.t) AS status, arg_max(props, c.t) AS props, arg_max(ts, c.t) AS at,
                       arg_max(event_id, c.t) AS seq
                FROM changes c JOIN inserts i ON c.job_id = i.job_id AND c.t > i.t WHERE NOT is_new GROUP BY c.job_id)
    SELECT job_id, 'pdf' AS job_type, coalesce(u.status, i.status) AS status, i.request AS request_json,
           CASE WHEN u.status <> 'error' THEN u.props END AS result_json, CASE WHEN u.status = 'error' THEN u.props END AS error_text,
           created_at, coalesce(u.at, i.at) AS updated_at, coalesce(u.seq, i.seq) AS seq
    FROM inserts i LEFT JOIN updates u USING (job_id)""",
)
def stream_job_table(spark, folder):
    """Changes in the order of time, a span of it in each of several micro-batches."""
    root, checkpoint = _places(spark, "job-table")
    landed = scratch_path(spark, "job-changes")
    failed, is_new = F.col("status") == "error", F.col("status").isin("signup", "purchase")
    changes = derived.job_events(spark, folder).select(
        "job_id",
        F.when(is_new, "insert").otherwise("update").alias("kind"),
        F.lit("pdf").alias("job_type"),
        "status",
        F.col("payload").alias("request_json"),
        F.when(~failed, F.col("payload")).alias("result_json"),
        F.when(failed, F.col("payload")).alias("error_text"),
        "ts",
        "seq",
    )
    bounds = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2100-01-01"]
    for k in range(len(bounds) - 1):
        low = F.lit(f"{bounds[k]} 00:00:00").cast("timestamp_ntz")
        span = (F.col("ts") < F.lit(f"{bounds[k + 1]} 00:00:00").cast("timestamp_ntz")) & ((F.col("ts") >= low) | F.lit(k == 0))
        changes.filter(span).coalesce(1).write.mode("append").parquet(landed)
        feed = feeds.read_feed(spark, landed, changes.schema)
        feeds.stream_job_table(feed, root, checkpoint, buckets=16).awaitTermination()
    return jobtable.read_job_table(spark, root)


@query("stream_job_dedupe", "SELECT DISTINCT user_id AS job_id FROM events")
def stream_job_dedupe(spark, folder):
    """Which repeat is kept depends on the order of arrival, so only the keys are shown."""
    out, checkpoint = _places(spark, "dedupe")
    feed = _landed_feed(spark, folder, "repeats-in", derived.job_events(spark, folder))
    once = feeds.stream_job_dedupe(feed, "3650 days")
    feeds.append(once, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("job_id")
