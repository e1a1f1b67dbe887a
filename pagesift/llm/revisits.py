"""Not-modified revisits in web archives, resolved to the response they stand for.

A crawler that is told "304 Not Modified" writes a revisit record without a payload. It
stands for the latest full response of the same canonical URL captured before it, if the
validators of both agree; headers that a 304 may renew are taken from the revisit.

The as-of join runs per canonical URL and span of time. What a span needs from the ones
before it is a single record, so a URL with very many captures is spread over its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values (HTTP): headers of a 304 response that renew those of the stored one.
RENEWED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

_URL = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)(/[^?]*)?(?:\?(.*))?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slashes,
    parameters in order; neither scheme nor fragment. What is no such URL stays as it is."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(plain, _URL, 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, _URL, 2), "/+$", "")
    search = F.regexp_extract(plain, _URL, 3)
    ordered = F.array_join(F.array_sort(F.split(search, "&", -1)), "&")
    query = F.when(search == "", F.lit("")).otherwise(F.concat(F.lit("?"), ordered))
    return F.when(plain.rlike(_URL), F.concat(host, path, query)).otherwise(url)


def _latest_before(records: DataFrame, span: int) -> DataFrame:
    """``records`` with ``full``: the latest response of the same ``key`` captured earlier."""
    order = F.struct("captured", "record_id")
    rows = records.withColumn("span", F.floor(F.col("captured") / span))
    answer = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "payload_digest"))
    rows = rows.withColumn("answer", answer)
    # At one moment revisits come first, so that a response at that moment is not earlier.
    within = Window.partitionBy("key", "span").orderBy("captured", F.col("kind") == "response", "record_id")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("near", F.last("answer", ignorenulls=True).over(within))
    last = rows.groupBy("key", "span").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), order)).alias("last"))
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("key", "span", F.last("last", ignorenulls=True).over(earlier).alias("far"))
    return rows.join(last, ["key", "span"]).withColumn("full", F.coalesce("near", "far")).drop("near", "far")


def resolve_revisits(records: DataFrame, span: int = 86_400) -> DataFrame:
    """``record_id, canonical_url, captured, status, response_id, headers, payload_digest``, one
    row for each revisit among ``records``.

    ``records`` has ``record_id, url, captured`` (seconds), ``kind`` (``response`` for a full
    response, ``revisit``, anything else is ignored), ``headers`` (a map with names in lower
    case) and ``payload_digest``. ``status`` is

    * ``resolved``: entity tags agree (weakly), or without them the times of last
      modification, or without those the payload digests. ``headers`` are those of the
      response, with the ``RENEWED`` ones of the revisit;
    * ``mismatch``: they differ, the page has changed since that response;
    * ``unverified``: there is nothing to compare;
    * ``orphan``: there is no earlier response, or the revisit has no URL or no time.

    Only ``resolved`` has headers and digest; ``response_id`` names the response found in any
    case. Of responses at one moment the largest ``record_id`` counts. Repeated revisits give
    repeated rows. Missing maps count as empty. Other columns are ignored; an empty table
    gives an empty table.
    """
    rows = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        canonical_url(F.col("url")).alias("key"),
        F.col("captured").cast("long").alias("captured"),
        "kind",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
        "payload_digest",
    )
    usable = F.col("key").isNotNull() & F.col("captured").isNotNull()
    found = _latest_before(rows.filter(usable), span).filter("kind = 'revisit'")
    lost = rows.filter(~usable & (F.col("kind") == "revisit"))
    lost = lost.withColumn("full", F.lit(None).cast(found.schema["full"].dataType))
    columns = ["record_id", "key", "captured", "headers", "payload_digest", "full"]
    both = found.select(*columns).union(lost.select(*columns))

    def weak(headers: str) -> Column:
        return F.regexp_replace(F.col(headers)["etag"], "^W/", "")

    def agree(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch"))

    status = F.coalesce(
        F.when(F.col("full").isNull(), "orphan"),
        agree(weak("headers"), weak("full.headers")),
        agree(F.col("headers")["last-modified"], F.col("full.headers")["last-modified"]),
        agree(F.col("payload_digest"), F.col("full.payload_digest")),
        F.lit("unverified"),
    )
    both = both.withColumn("status", status)
    renewed = F.map_filter("headers", lambda name, _: name.isin(*RENEWED))
    kept = F.map_filter("full.headers", lambda name, _: ~F.array_contains(F.map_keys(renewed), name))
    resolved = F.col("status") == "resolved"
    return both.select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "captured",
        "status",
        F.col("full.record_id").alias("response_id"),
        F.when(resolved, F.map_concat(kept, renewed)).alias("headers"),
        F.when(resolved, F.col("full.payload_digest")).alias("payload_digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive records made from landed pages: for each a full response and three revisits,
    one with its entity tag made weak, one with another tag, one before the response.

    The payload stays where it is; a record has its digest.
    """
    digest = F.md5("html")
    time = F.lit(1_700_000_000) + F.col("page_id") * 7919 % 2_592_000
    rows = pages.select("page_id", "url", digest.alias("h"), time.alias("t"), F.octet_length("html").alias("size"))

    def headers(**values: Column) -> Column:
        pairs = [part for name, value in values.items() for part in (F.lit(name.replace("_", "-")), value)]
        return F.create_map(*pairs)

    def record(k: int, url: Column, captured: Column, kind: str, of: Column, payload: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 4 + k).alias("record_id"),
            url.alias("url"),
            captured.alias("captured"),
            F.lit(kind).alias("kind"),
            of.alias("headers"),
            payload.alias("payload_digest"),
        )

    quoted = F.concat(F.lit('"'), "h", F.lit('"'))
    modified, none = F.col("t").cast("string"), F.lit(None).cast("string")
    renewed = {"cache_control": F.lit("max-age=600"), "content_length": F.lit("0")}
    first = headers(
        etag=quoted,
        last_modified=modified,
        content_type=F.lit("text/html"),
        content_length=F.col("size").cast("string"),
        cache_control=F.lit("max-age=60"),
    )
    records = F.array(
        record(0, F.col("url"), F.col("t"), "response", first, F.col("h")),
        record(
            1,
            F.regexp_replace("url", "^http", "HTTP"),
            F.col("t") + 3600,
            "revisit",
            headers(etag=F.concat(F.lit("W/"), quoted), **renewed),
            none,
        ),
        record(
            2,
            F.concat("url", F.lit("#again")),
            F.col("t") + 7200,
            "revisit",
            headers(etag=F.concat(F.lit('"x'), "h", F.lit('"')), **renewed),
            none,
        ),
        record(3, F.col("url"), F.col("t") - 100, "revisit", headers(last_modified=modified, **renewed), none),
    )
    return rows.select(F.inline(records))
