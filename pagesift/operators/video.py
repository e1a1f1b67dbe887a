"""Video facts from the JSON blob that watch pages carry in a script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.nodes import attr
from pagesift.functions.text import last_or_blank, strip
from pagesift.functions.urls import is_video_url
from pagesift.sources.html import page_nodes

# The assignment that holds the blob, up to the end of its script, or
# failing that up to the first closing brace and semicolon.
BLOB_TO_SCRIPT_END = r"(?s)ytInitialPlayerResponse\s*=\s*(\{.*?\})\s*;\s*</script>"
BLOB_TO_SEMICOLON = r"(?s)ytInitialPlayerResponse\s*=\s*(\{.*?\})\s*;\s*"
DESCRIPTION_LIMIT = 4000
PLATFORM = "youtube"


def blob_of(html: Column, url: Column) -> Column:
    """The JSON text of a watch page, NULL for any other page or without a blob."""
    to_script_end = F.regexp_extract(html, BLOB_TO_SCRIPT_END, 1)
    to_semicolon = F.regexp_extract(html, BLOB_TO_SEMICOLON, 1)
    found = F.when(to_script_end != "", to_script_end).otherwise(F.nullif(to_semicolon, F.lit("")))
    return F.when(is_video_url(url), found)


def is_record(data: Column) -> Column:
    """True for a variant that holds a JSON object."""
    return F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))


def video_of(data: Column, nodes: Column, url: Column) -> Column:
    """The video struct of a parsed blob.

    A count that is absent or empty is 0, one that is no number is NULL.
    """

    def text(path: str) -> Column:
        return F.coalesce(F.try_variant_get(data, path, "string"), F.lit(""))

    def count(path: str) -> Column:
        return F.when(text(path) == "", F.lit(0).cast("bigint")).otherwise(
            strip(text(path)).try_cast("bigint")
        )

    og = F.get(
        F.filter(nodes, lambda n: (n["tag"] == "meta") & (n["attrs"].getItem("property") == "og:title")),
        F.lit(0),
    )
    title = text("$.videoDetails.title")
    thumbs = F.try_variant_get(data, "$.videoDetails.thumbnail.thumbnails", "array<struct<url: string>>")
    return F.struct(
        F.lit(PLATFORM).alias("platform"),
        url.alias("url"),
        text("$.videoDetails.videoId").alias("video_id"),
        F.when(title != "", title).otherwise(strip(attr(og, "content"))).alias("title"),
        text("$.videoDetails.author").alias("channel"),
        F.substring(text("$.videoDetails.shortDescription"), 1, DESCRIPTION_LIMIT).alias(
            "short_description"
        ),
        count("$.videoDetails.lengthSeconds").alias("duration_seconds"),
        count("$.videoDetails.viewCount").alias("view_count"),
        text("$.microformat.playerMicroformatRenderer.publishDate").alias("publish_date"),
        text("$.microformat.playerMicroformatRenderer.category").alias("category"),
        last_or_blank(F.transform(thumbs, lambda t: t["url"])).alias("thumbnail"),
        F.coalesce(
            F.try_variant_get(data, "$.videoDetails.isLiveContent", "boolean"), F.lit(False)
        ).alias("is_live"),
    )


def video_metadata(pages: DataFrame) -> DataFrame:
    """One row per watch page with readable data. Other pages are dropped before parsing."""
    watch = pages.filter(is_video_url(F.col("url"))).withColumn(
        "blob", blob_of(F.col("html"), F.col("url"))
    )
    parsed = page_nodes(
        watch,
        tags=("meta",),
        attrs=("property", "content"),
        keep_noise=True,
        keep=("page_id", "url", "blob"),
    ).withColumn("data", F.try_parse_json("blob"))
    video = video_of(F.col("data"), F.col("nodes"), F.col("url"))
    # As the item of a generator, because a filter on a plain column would be pushed
    # down and parse the data a second time.
    found = F.array(F.when(is_record(F.col("data")), video))
    rows = parsed.select("page_id", F.explode_outer(found).alias("video"))
    return rows.filter("video is not null").select("page_id", "video.*")
