"""Pages and documents derived from the given tables, row by row.

The given ``pages`` have no tables, images, PDF links, rich meta tags or videos, so
queries on these write markup from rows of the other tables. One row gives one page or
document: nothing is gathered, and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.catalog.registry import table

SHOP = "https://shop.example.com"
DOCS = "https://docs.example.com"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pages(df: DataFrame, key: str, url: Column, html: Column) -> DataFrame:
    return df.select(F.col(key).alias("page_id"), url.alias("url"), html.alias("html"))


def image_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per part: two images, one without and one with a blank source."""
    c = F.col
    html = _text(
        '<html><body><h1>', c("p_name"), '</h1><img src="/img/', c("p_partkey"), '.jpg" alt="',
        c("p_name"), '" width="', c("p_size"), '"><img alt="none"><img src="  ">'
        '<p><img title="', c("p_type"), '" src=" thumb/', c("p_partkey"), '.png " height=',
        c("p_size"), "></body></html>",
    )
    return _pages(table(spark, folder, "part"), "p_partkey", _text(SHOP, "/c/", c("p_partkey"), "/p?a=1"), html)


def table_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per customer: a captioned table, an empty one, a nested pair; cells left open."""
    c = F.col
    html = _text(
        "<html><body><table><caption> ", c("c_mktsegment"), "\n</caption><tr><th>key<th>name</tr><tr><td>",
        c("c_custkey"), "<td> ", c("c_name"), " <tr><td></td></tr></table><table><tr><td> </td></tr></table>"
        "<table><tr><td>", c("c_acctbal"), "</td><td><table><tr><td>n<b>", c("c_nationkey"),
        "</b></td></tr></table></td></tr></table></body></html>",
    )
    return _pages(table(spark, folder, "customer"), "c_custkey", _text(SHOP, "/t/", c("c_custkey")), html)


def meta_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per customer with meta tags of every kind, one of them empty."""
    c = F.col
    html = _text(
        '<head><meta charset=utf-8><title>', c("c_name"), '</title><meta name="description" content=" ',
        c("c_mktsegment"), ' &amp; more "><meta property="og:title" content="', c("c_name"),
        '"><meta name=""><meta http-equiv="refresh" content="', c("c_nationkey"), '"></head><p>',
        c("c_mktsegment"), "</p>",
    )
    return _pages(table(spark, folder, "customer"), "c_custkey", _text(SHOP, "/m/", c("c_custkey")), html)


def pdf_link_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per part with links of every kind. All pages link to document 0."""
    c = F.col
    k = c("p_partkey")
    html = _text(
        "<ul><li><a href='/d/", k, ".pdf'>first</a><li><a href='/d/", k, ".PDF'>upper</a>"
        "<li><a href='d/", k, ".pdf?v=1'>query</a><li><a href='/d/", k, ".pdf#p'>fragment</a>"
        "<li><a href='../", k, ".html'>page</a><li><a href='mailto:a@example.com'>mail</a>"
        "<li><a href='javascript:go()'>script</a><li><a href=''>self</a><li><a name=x>anchor</a>"
        "<li><a href='/d/", k, ".pdf'>again</a><li><a href=\"/d/0.pdf\">shared</a></ul>",
    )
    return _pages(table(spark, folder, "part"), "p_partkey", _text(DOCS, "/s/", k, "/index.html"), html)


def linked_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that have landed: those of parts of size 25 and below, and document 0."""
    parts = table(spark, folder, "part").filter("p_size <= 25 or p_partkey = 0")
    return parts.select(
        F.col("p_partkey").alias("doc_id"), _text(DOCS, "/d/", F.col("p_partkey"), ".pdf").alias("url")
    )


def landed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``linked_documents`` with their content: one page with the part's name."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.array("p_name").alias("pages"))
    none = F.array().cast("array<struct<page_no: int, table_index: int, grid: array<array<string>>>>")
    landed = linked_documents(spark, folder).join(parts, "doc_id")
    meta = F.create_map().cast("map<string, string>")
    return landed.select("doc_id", "url", meta.alias("meta"), "pages", none.alias("grids"))


def pdf_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """A file per supplier, in a folder per nation: suffixes vary, every fifth is no PDF."""
    c = F.col
    key = c("s_suppkey")
    suffix = F.get(F.array(*[F.lit(s) for s in (".pdf", ".PDF", ".Pdf", ".txt")]), (key % 4).cast("int"))
    pages = F.repeat(F.lit("<< /Type /Page >>\n"), (key % 3).cast("int"))
    good = _text("%PDF-1.4\n", pages, "/Type /Pages ", c("s_name"))
    body = F.when(key % 5 != 0, good).otherwise(_text("no file ", c("s_name")))
    return table(spark, folder, "supplier").select(
        _text("nation=", c("s_nationkey"), "/", key, suffix).alias("file"), body.cast("binary").alias("body")
    )


def video_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page per order: hosts, counts and thumbnails vary with its status and priority."""
    c = F.col
    host = F.when(c("o_orderstatus") == "P", "m.youtube.com").otherwise("www.youtube.com")
    path = F.when(c("o_orderpriority") == "5-LOW", "/shorts").otherwise("/watch")
    length = F.when(c("o_orderstatus") == "O", "").otherwise(
        _text(',"lengthSeconds":"', c("o_custkey"), '"')
    )
    views = F.when(c("o_orderstatus") == "F", _text('"', c("o_orderkey"), '"')).otherwise(
        c("o_orderkey").cast("string")
    )
    title = F.when(c("o_orderpriority") == "1-URGENT", "").otherwise(_text("Order ", c("o_orderkey")))
    thumbs = F.when(c("o_orderpriority") == "2-HIGH", "").otherwise(
        _text('{"url":"/s.jpg"},{"url":"/t', c("o_orderkey"), '.jpg"}')
    )
    end = F.when(c("o_orderstatus") == "P", ";go();</script>").otherwise(";</script>")
    html = _text(
        '<html><head><meta property="og:title" content=" Og ', c("o_orderkey"),
        ' "><script>var ytInitialPlayerResponse = {"videoDetails":{"videoId":"v', c("o_orderkey"),
        '","title":"', title, '","author":"c', c("o_custkey"),
        '","shortDescription":"a {b} & \\"c\\""', length, ',"viewCount":', views,
        ',"isLiveContent":', F.col("o_orderstatus") == "F", ',"thumbnail":{"thumbnails":[', thumbs,
        ']}},"microformat":{"playerMicroformatRenderer":{"publishDate":"',
        F.date_format("o_orderdate", "yyyy-MM-dd"), '","category":"', c("o_orderpriority"), '"}}}', end,
        "</head><body><h1>x</h1></body></html>",
    )
    url = _text("https://", host, path, "?v=", c("o_orderkey"))
    return _pages(table(spark, folder, "orders"), "o_orderkey", url, html)


def paged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Landed documents: each line of a text is a page; two small grids on pages 1 and 2."""
    c = F.col
    pages = F.split("text", "\n")
    facts = F.array(
        F.array(F.lit("lang"), F.lit("source | place"), F.lit("chars")),
        F.array(F.lit(None).cast("string"), F.lit(""), F.lit("")),
        F.array(c("lang"), c("source"), c("n_chars").cast("string")),
        F.array(F.lit(" "), F.lit("x\ny")),
    )
    first_line = F.array(F.array(F.get(pages, F.lit(0)), c("lang")), F.array(c("source"), F.lit(",")))

    def grid(page_no: int, index: int, cells: Column) -> Column:
        return F.struct(F.lit(page_no).alias("page_no"), F.lit(index).alias("table_index"), cells.alias("grid"))

    return table(spark, folder, "documents").select(
        "doc_id",
        _text(DOCS, "/", c("source"), "/", c("doc_id"), ".pdf").alias("url"),
        F.create_map(F.lit("Title"), c("source"), F.lit("Author"), c("lang")).alias("meta"),
        pages.alias("pages"),
        F.array(grid(1, 0, facts), grid(2, 0, first_line)).alias("grids"),
    )


def order_grids(spark: SparkSession, folder: str) -> DataFrame:
    """A document per order with one raw grid; urgent orders have a header cell of 64 characters."""
    c = F.col
    last = F.when(c("o_orderpriority") == "1-URGENT", F.repeat(F.lit("priority"), 8)).otherwise("priority")
    none = F.lit(None).cast("string")
    cells = F.array(
        F.array(F.lit("order"), F.lit("status|x"), last),
        F.array(c("o_orderkey").cast("string"), c("o_orderstatus"), _text(" ", c("o_orderpriority"), "\nx ")),
        F.array(none, F.lit(""), none),
        F.array(none, F.lit(" ")),
        F.array(c("o_custkey").cast("string"), F.lit("a, \"b\"")),
    )
    grid = F.struct(F.lit(3).alias("page_no"), F.lit(1).alias("table_index"), cells.alias("grid"))
    return table(spark, folder, "orders").select(c("o_orderkey").alias("doc_id"), F.array(grid).alias("grids"))


def page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as documents with one row per page."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text"
    )


def source_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """Every source as one document with a page per text."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text"
    )


def job_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as status changes of a job per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"),
        F.col("event_type").alias("status"), F.col("props").alias("payload"), "value",
    )


def key_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as uses of a key per user."""
    key = F.format_string("Customer#%09d", "user_id")
    return table(spark, folder, "events").select("event_id", "ts", key.alias("api_key"))


def api_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A key per customer, active when the balance is positive."""
    return table(spark, folder, "customer").select(
        F.sha2(F.col("c_name").cast("binary"), 256).alias("key_hash"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def job_table(spark: SparkSession, folder: str) -> DataFrame:
    """A job per customer, made when the first order could be."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_custkey").alias("job_id"),
        F.lit("scrape").alias("job_type"),
        F.lit("PENDING").alias("status"),
        F.to_json(F.struct(F.col("c_name").alias("url"))).alias("request_json"),
        F.lit('{"ok": true}').alias("result_json"),
        F.lit(None).cast("string").alias("error_text"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


def run_requests_table(spark: SparkSession, folder: str) -> DataFrame:
    """A run request per part, started from its link page or from a PDF, in varied modes."""
    c = F.col
    k = c("p_partkey")
    mode = (
        F.when(c("p_type") == "ECONOMY", "links")
        .when(c("p_size") > 45, "custom")
        .when(c("p_size") < 5, "text")
        .otherwise("all")
    )
    url = (
        F.when(c("p_size") == 20, _text(DOCS, "/d/", k, ".pdf?x=1"))
        .when(c("p_size") == 21, _text(DOCS, "/d/", k, ".pdf"))
        .when(c("p_size") == 22, _text(DOCS, "/gone/", k))
        .otherwise(_text(DOCS, "/s/", k, "/index.html"))
    )
    return table(spark, folder, "part").select(
        k.alias("request_id"),
        url.alias("url"),
        mode.alias("scrape_mode"),
        F.lit("json").alias("scrape_format"),
        (c("p_size") != 30).alias("follow_pdfs"),
        F.lit("all").alias("pdf_op"),
        F.lit("md").alias("pdf_format"),
    )
