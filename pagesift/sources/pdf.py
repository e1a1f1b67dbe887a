"""PDF files and landed documents: file scan, payload checks, document facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a PDF begins, its media type, and how its page objects are marked.
PDF_MAGIC = b"%PDF-"
PDF_MEDIA_TYPE = "application/pdf"
PAGE_OBJECT = r"/Type\s*/Page\b"
# Document fact -> its key in the file's own metadata.
INFO_KEYS = {
    "title": "Title",
    "author": "Author",
    "subject": "Subject",
    "creator": "Creator",
    "created": "CreationDate",
    "modified": "ModDate",
}


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of every ``*.pdf`` under a folder.

    The suffix may be in any case; other files are never opened. A path that is
    missing raises, as does a single file with another suffix.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and "*" not in name and not name.lower().endswith(".pdf"):
        raise ValueError(f"Not a PDF file: {path}")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)


def is_pdf_payload(content_type: Column, content: Column) -> Column:
    """The media type says PDF, or the bytes do."""
    by_type = F.lower(F.coalesce(content_type, F.lit(""))).contains(PDF_MEDIA_TYPE)
    head = F.substring(content, 1, len(PDF_MAGIC))
    return by_type | F.coalesce(head == F.lit(PDF_MAGIC), F.lit(False))


def pdf_validity(df: DataFrame) -> DataFrame:
    """``df`` with ``is_valid`` and, for rejects, a ``reason``."""
    valid = is_pdf_payload(F.col("content_type"), F.col("content"))
    shown = F.coalesce(F.nullif(F.lower("content_type"), F.lit("")), F.lit("?"))
    return df.withColumn("is_valid", valid).withColumn(
        "reason", F.when(~F.col("is_valid"), F.concat(F.lit("not a PDF, content type "), shown))
    )


def split_valid_pdfs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a PDF payload, and the rejected rows with a ``reason``."""
    checked = pdf_validity(df)
    return checked.filter("is_valid").drop("is_valid", "reason"), checked.filter("not is_valid").drop("is_valid")


def page_count(content: Column) -> Column:
    """Pages in a file by its page objects, at least 1. ``/Pages`` does not count."""
    text = F.decode(content, "ISO-8859-1")
    return F.greatest(F.regexp_count(text, F.lit(PAGE_OBJECT)), F.lit(1))


def pdf_page_count(df: DataFrame) -> DataFrame:
    """``df`` without its bytes, with ``total_pages``."""
    return df.withColumn("total_pages", page_count(F.col("content"))).drop("content")


def doc_info_of(pages: Column, meta: Column) -> Column:
    """``struct<total_pages, title, author, subject, creator, created, modified>``."""
    facts = [F.coalesce(meta.getItem(key), F.lit("")).alias(name) for name, key in INFO_KEYS.items()]
    return F.struct(F.size(pages).alias("total_pages"), *facts)


def doc_info(docs: DataFrame) -> DataFrame:
    """One row per landed document with its facts."""
    info = doc_info_of(F.col("pages"), F.col("meta"))
    return docs.select("doc_id", info.alias("info")).select("doc_id", "info.*")
