"""Runs over many start URLs: extract, follow PDF links, process, keep a manifest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import file_stem, output_name
from pagesift.functions.urls import is_pdf_href, is_pdf_url, may_be_pdf_href, url_filename
from pagesift.operators.extract import MODES, extract, extract_asked, link_targets
from pagesift.operators.render import page_bodies, page_body
from pagesift.operators.write import write_as, write_bodies
from pagesift.plans.choice import key_filter, rows_among
from pagesift.plans.documents import bodies_asked
from pagesift.plans.scratch import written
from pagesift.plans.skew import split_hot_keys_join
from pagesift.schema import DOC_OPS, FORMATS, check_choice
from pagesift.sources.archives import ARCHIVE_BYTES, write_archives

# Modes whose result holds a list of links to follow.
FOLLOW_MODES = ("all", "links")


def pdf_links(links: DataFrame) -> DataFrame:
    """The links a run follows: those that end in ``.pdf``, repeats included."""
    return links.filter(is_pdf_href(F.col("href")))


def landed_urls(docs: DataFrame) -> DataFrame:
    """url and doc_id of landed documents, each URL once: the slim side of link lookups."""
    return docs.filter("url is not null").groupBy("url").agg(F.min("doc_id").alias("doc_id"))


def follow_links(links: DataFrame, docs: DataFrame, splits: int | None = None) -> DataFrame:
    """Links joined to the landed document of their target.

    One document may be the target of a large share of all links. Adaptive execution
    splits such a join by size; ``splits`` deals hot targets out beforehand (reads
    ``links`` twice, so give it a stored table).
    """
    return _lookup(links, docs, "inner", splits)


def unresolved_links(links: DataFrame, docs: DataFrame, splits: int | None = None) -> DataFrame:
    """Links whose target has not landed."""
    return _lookup(links, docs, "left_anti", splits)


def _lookup(links: DataFrame, docs: DataFrame, how: str, splits: int | None) -> DataFrame:
    targets = landed_urls(docs).withColumnRenamed("url", "href")
    if splits is None:
        return links.join(targets, "href", how)
    return split_hot_keys_join(links, targets, "href", how, splits)


def page_pdf_links(pages: DataFrame) -> DataFrame:
    """url and the PDF links of each page, in page order. Links that cannot be any are not resolved."""
    return link_targets(pages, may_be_pdf_href).select("url", F.filter("hrefs", is_pdf_href).alias("hrefs"))


def pdf_worklist(requests: DataFrame, pages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """What each request asks to process: request_id, pos, target, source.

    A start URL that is a PDF is its own work (``direct``); otherwise the PDF links of
    the page are, where the request follows them (``followed``). ``pages`` has each URL
    once. ``links`` is a stored table of ``page_pdf_links``, so that markup is read once in
    a page's life; without it each page is parsed here, once however many requests
    start from it. Either way only URLs and links meet the requests, never markup.
    """
    url = F.col("url")
    follows = F.col("follow_pdfs") & F.col("scrape_mode").isin(*FOLLOW_MODES) & ~is_pdf_url(url)
    hrefs = page_pdf_links(pages) if links is None else links
    # A filter on the links themselves would be moved below and resolve each of them a second time.
    hrefs = hrefs.select("url", F.explode_outer(F.array("hrefs")).alias("hrefs")).filter(F.size("hrefs") > 0)
    tagged = requests.withColumn("follows", follows).join(hrefs, "url", "left")
    work = (
        F.when(is_pdf_url(url), F.array(_work(url, "direct")))
        .when(F.col("follows"), F.transform("hrefs", lambda h: _work(h, "followed")))
    )
    rows = tagged.select(
        "request_id", "pdf_op", "pdf_format", F.posexplode_outer(work).alias("pos", "work")
    )
    return rows.filter("pos is not null").select(
        "request_id", "pos", "work.target", "work.source", "pdf_op", "pdf_format"
    )


def _work(target: Column, source: str) -> Column:
    return F.struct(target.alias("target"), F.lit(source).alias("source"))


def run_outputs(
    requests: DataFrame, pages: DataFrame, docs: DataFrame, at: Column, links: DataFrame | None = None
) -> DataFrame:
    """Every output and error of every request: request_id, seq, type, file, source, error.

    A target that has not landed leaves neither, as a failed download does. Each request has
    a folder, and each file of it a name of its own: a document's starts with its position.
    ``links`` is as in ``pdf_worklist``.
    """
    return _outputs(requests, pages, docs, at, links).drop("kind", "format")


def _outputs(
    requests: DataFrame, pages: DataFrame, docs: DataFrame, at: Column, links: DataFrame | None
) -> DataFrame:
    """The rows of ``run_outputs`` and what makes their files: ``kind`` (mode or operation), ``format``."""
    known = pages if links is None else links
    landed = known.select("url").distinct().withColumn("landed", F.lit(True))
    problem = (
        F.when(
            ~F.col("scrape_mode").isin(*MODES),
            F.concat(F.lit("scrape: Unknown mode '"), "scrape_mode", F.lit("'")),
        )
        .when(F.col("scrape_mode") == "custom", "scrape: CSS selector required for mode='custom'")
        .when(
            ~F.col("scrape_format").isin(*FORMATS),
            F.concat(F.lit("scrape: Unknown format '"), "scrape_format", F.lit("'")),
        )
        .when(F.col("landed").isNull(), "scrape: page not found")
    )
    scraped = requests.join(landed, "url", "left").withColumn("error", problem)
    folder = F.concat(F.col("request_id").cast("string"), F.lit("/"))
    name = output_name(F.lit("scraped"), F.col("scrape_mode"), F.col("scrape_format"), at)
    first = scraped.select(
        "request_id",
        F.lit(-1).alias("seq"),
        F.lit("scrape").alias("type"),
        F.when(F.col("error").isNull(), F.concat(folder, name)).alias("file"),
        F.col("url").alias("source"),
        "error",
        F.col("scrape_mode").alias("kind"),
        F.col("scrape_format").alias("format"),
    )
    targets = landed_urls(docs).select(F.col("url").alias("target"))
    # A document that cannot be processed or exported leaves no output.
    work = pdf_worklist(requests, pages, links)
    work = work.filter(F.col("pdf_op").isin(*DOC_OPS) & F.col("pdf_format").isin(*FORMATS))
    done = work.join(targets, "target", "left_semi")
    stem = F.concat_ws("_", F.col("pos").cast("string"), file_stem(url_filename(F.col("target"))))
    pdfs = done.select(
        "request_id",
        F.col("pos").alias("seq"),
        F.lit("pdf").alias("type"),
        F.concat(
            folder, F.lit("pdf/"), output_name(stem, F.col("pdf_op"), F.col("pdf_format"), at)
        ).alias("file"),
        F.col("target").alias("source"),
        F.lit(None).cast("string").alias("error"),
        F.col("pdf_op").alias("kind"),
        F.col("pdf_format").alias("format"),
    )
    return first.unionByName(pdfs)


def run_bodies(
    requests: DataFrame,
    pages: DataFrame,
    docs: DataFrame,
    at: Column,
    links: DataFrame | None = None,
    fn: Callable[[str], str] | None = None,
) -> DataFrame:
    """The files of ``run_outputs`` with what they hold: request_id, seq, type, file, source, body.

    A page or document is rendered once for each mode or operation, format and prompt that
    somebody asks for, however many requests do, and then meets their files; a source that
    many requests share is dealt out. What is asked travels with the page or document, so each is
    read and taken apart in one pass whatever is asked of it, and only what is asked for: a
    filter made of the list of asked URLs, of any length, keeps the others out of the join with it.
    ``requests`` may have an ``ai_prompt`` for ``fn``, see ``process_docs``. The list of files
    is written first, and those of the at most 44 pairs of kind and format that occur are
    gathered, to plan no others. ``pages`` has each URL once; of documents with one URL the
    first counts.
    """
    prompt = F.col("ai_prompt") if "ai_prompt" in requests.columns else F.lit(None).cast("string")
    files = _outputs(requests, pages, docs, at, links).filter("file is not null").drop("error")
    files = files.join(requests.select("request_id", prompt.alias("prompt")), "request_id")
    # A page does not depend on the prompt.
    files = files.withColumn("prompt", F.when(F.col("type") == "pdf", F.col("prompt")))
    made_of = F.struct("type", "kind", "format", "source", "prompt")
    files = written(files.withColumn("what", F.to_json(made_of)), "files")
    shown = ("request_id", "seq", "type", "file", "source")
    bodies = rendered_files(files, pages, docs, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fn)
    if bodies is None:
        return files.select(*shown, F.lit(None).cast("string").alias("body"))
    return split_hot_keys_join(files, written(bodies, "bodies"), "what").select(*shown, "body")


def rendered_files(
    files: DataFrame, pages: DataFrame, docs: DataFrame, time: str | Column, fn: Callable[[str], str] | None = None
) -> DataFrame | None:
    """``what, body`` for every different thing that ``files`` (type, kind, format, source, prompt,
    what) hold; None if there are no files."""
    pairs = sorted(tuple(row) for row in files.select("type", "kind", "format").distinct().collect())
    parts = []
    if of_pages := [pair[1:] for pair in pairs if pair[0] == "scrape"]:
        parts.append(_page_bodies(files.filter("type = 'scrape'"), of_pages, pages, time))
    if len(of_pages) < len(pairs):
        parts.append(_doc_bodies(files.filter("type = 'pdf'"), docs, time, fn))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _page_bodies(files: DataFrame, pairs: list[tuple[str, str]], pages: DataFrame, time: str | Column) -> DataFrame:
    """The bodies asked of pages. A page has at most as many as there are ``pairs``."""
    key = F.concat_ws("/", "kind", "format")
    asked = files.select(F.col("source").alias("url"), F.struct(key.alias("key"), "what").alias("one"))
    asked = asked.groupBy("url").agg(F.map_from_entries(F.collect_set("one")).alias("wanted"))
    chosen = rows_among(pages.select("url", "html"), written(asked, "asked-pages"), "url")
    modes = F.transform(F.map_keys("wanted"), lambda k: F.substring_index(k, "/", 1))
    chosen = chosen.withColumn("asked", F.array_distinct(modes))
    found = extract_asked(chosen, sorted({kind for kind, _ in pairs}), keep=("url", "wanted"))

    def body(kind: str, fmt: str) -> Column:
        what = F.col("wanted").getItem(f"{kind}/{fmt}")
        made = page_body(kind, fmt, time, F.col(kind).getField)
        return F.when(what.isNotNull(), F.struct(what.alias("what"), made.alias("body")))

    made = F.array_compact(F.array(*[body(kind, fmt) for kind, fmt in pairs]))
    rows = found.select(F.explode_outer(made).alias("made"))
    return rows.filter("made is not null").select("made.what", "made.body")


#: Reports that one row of a document carries. A document of which more are asked has several rows.
REPORTS = 64


def _doc_bodies(files: DataFrame, docs: DataFrame, time: str | Column, fn: Callable[[str], str] | None) -> DataFrame:
    """The bodies asked of documents."""
    asked = files.select(F.col("source").alias("url"), "kind", "format", "prompt", "what").distinct()
    asked = written(asked, "asked-reports")
    blocks = asked.groupBy("url").agg(F.ceil(F.count("*") / REPORTS).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("what"), F.col("blocks"))
    one = F.struct("kind", "format", "prompt", "what")
    dealt = asked.join(blocks, "url").groupBy("url", block.alias("block")).agg(F.collect_list(one).alias("wanted"))
    dealt = written(dealt.join(landed_urls(docs), "url"), "asked-documents")
    may_be = key_filter(dealt, "doc_id")
    chosen = docs.filter(may_be(F.col("doc_id"))).join(dealt.drop("block"), ["url", "doc_id"])
    return bodies_asked(chosen, time, fn)


def write_run(requests: DataFrame, pages: DataFrame, docs: DataFrame, at: Column, out: str, **options) -> str:
    """Write what ``run_bodies`` gives as a table and return its folder."""
    return write_bodies(run_bodies(requests, pages, docs, at, **options), out)


def write_run_archives(
    requests: DataFrame, pages: DataFrame, docs: DataFrame, at: Column, out: str, most: int = ARCHIVE_BYTES, **options
) -> str:
    """Pack the files of ``run_bodies`` under their names into archives, see ``write_archives``."""
    bodies = run_bodies(requests, pages, docs, at, **options).select("file", "body")
    return write_archives(written(bodies, "run-files"), out, most)


def run_manifest(outputs: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request: request_id, url, outputs in order, errors.

    A request gathers as many rows as its page has links, which sat in one row before.
    """
    item = F.struct("seq", "type", "file", "source")
    grouped = outputs.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("file").isNotNull(), item))).alias("done"),
        F.collect_list("error").alias("errors"),
    )
    listed = F.transform("done", lambda o: F.struct(o["type"], o["file"], o["source"]))
    return requests.select("request_id", "url").join(
        grouped.select("request_id", listed.alias("outputs"), "errors"), "request_id"
    )


def run_requests(
    requests: DataFrame,
    pages: DataFrame,
    docs: DataFrame,
    at: Column,
    completed_at: Column | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Manifests of a table of requests: request_id, started_at, completed_at, url, outputs,
    errors. ``at`` also dates the file names. ``links`` is as in ``pdf_worklist``."""
    manifest = run_manifest(run_outputs(requests, pages, docs, at, links), requests)
    times = {"started_at": at, "completed_at": at if completed_at is None else completed_at}
    shown = [F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias(n) for n, t in times.items()]
    return manifest.select("request_id", *shown, "url", "outputs", "errors")


def write_manifest(manifest: DataFrame, path: str) -> str:
    """One JSON object per run."""
    return write_as(manifest, "json", path)


def extract_and_write(
    pages: DataFrame, mode: str, fmt: str, out: str, at: str | Column, **options
) -> str:
    """Extract, render and write in one go: a row per page with page_id, url and body. Bad
    names raise before anything runs."""
    check_choice("format", fmt, FORMATS)
    return write_bodies(page_bodies(extract(pages, mode, **options), mode, fmt, at), out)


def extract_and_pack(pages: DataFrame, mode: str, fmt: str, out: str, at: Column, **options) -> str:
    """Extract, render and pack in one go: a named file for each page in a folder of its id."""
    check_choice("format", fmt, FORMATS)
    made = page_bodies(extract(pages, mode, **options), mode, fmt, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
    name = output_name(F.lit("scraped"), F.lit(mode), F.lit(fmt), at)
    named = made.select(F.concat(F.col("page_id").cast("string"), F.lit("/"), name).alias("file"), "body")
    return write_archives(written(named, "page-files"), out)
