"""Feeds of pages, documents, requests and job changes.

Each feed runs the function that the batch side runs, so both give the same rows. Sinks
write one folder per micro-batch where a batch may be tried again, which makes a repeat
overwrite itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagesift.operators.extract import explode_items, extract
from pagesift.operators.jobs import job_latest
from pagesift.plans.documents import process_docs
from pagesift.plans.jobtable import BUCKETS, apply_changes, create_job_table
from pagesift.plans.runs import run_bodies, run_requests

EVERYTHING = {"availableNow": True}


def read_feed(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as they arrive in a folder, or as they match a glob."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def stream_extract(
    pages: DataFrame, mode: str, out: str, checkpoint: str, trigger: dict = EVERYTHING, **options
) -> StreamingQuery:
    """Pages arriving: extraction results appended. List modes give one row per item."""
    extracted = extract(pages, mode, **options)
    rows = extracted if mode in ("all", "essential") else explode_items(extracted)
    return append(rows, out, checkpoint, trigger)


def stream_docs(
    docs: DataFrame, op: str, out: str, checkpoint: str, trigger: dict = EVERYTHING, **options
) -> StreamingQuery:
    """Landed documents arriving: processed rows appended. A document is one row, so the
    ordered text needs no state."""
    return append(process_docs(docs, op, **options), out, checkpoint, trigger)


def stream_runs(
    requests: DataFrame,
    pages: DataFrame,
    docs: DataFrame,
    at: Column,
    out: str,
    checkpoint: str,
    trigger: dict = EVERYTHING,
    links: DataFrame | None = None,
) -> StreamingQuery:
    """Run requests arriving: manifests, against the pages and documents landed by then.

    Give the stored ``links`` of the pages, or each batch parses all of them again.
    """

    def work(batch: DataFrame) -> DataFrame:
        return run_requests(batch, pages, docs, at, links=links)

    return _per_batch(requests, work, out, checkpoint, trigger)


def stream_awaited_pages(requests: DataFrame, pages: DataFrame, delay: str, before: str = "3650 days") -> DataFrame:
    """Requests and landed pages, both arriving: one row per request with the page it waited for, or
    with an ``error`` once the page is overdue.

    ``requests`` has request_id, url and asked_at, ``pages`` has page_id, url and landed_at, each URL
    once. A request takes a page that landed up to ``before`` earlier or ``delay`` later. The
    time of both feeds, less ``delay``, tells when nothing can come any more: a request is then
    forgotten with its error, and a page when no request can reach back to it, which bounds what
    is kept. Rows without a time or URL find nothing; a request without a time is never answered.
    """
    asked = requests.withColumn("asked_at", F.col("asked_at").cast("timestamp")).withWatermark("asked_at", delay)
    landed = pages.select("page_id", F.col("url").alias("landed_url"), F.col("landed_at").cast("timestamp").alias("landed_at"))
    landed = landed.withWatermark("landed_at", delay)
    meets = F.expr(
        f"url = landed_url and landed_at >= asked_at - interval {before} and landed_at <= asked_at + interval {delay}"
    )
    rows = asked.join(landed, meets, "left_outer")
    error = F.when(F.col("page_id").isNull(), "scrape: page not found")
    return rows.select("request_id", "url", "asked_at", "page_id", "landed_at", error.alias("error"))


def stream_run_bodies(
    requests: DataFrame,
    pages: DataFrame,
    docs: DataFrame,
    at: Column,
    out: str,
    checkpoint: str,
    trigger: dict = EVERYTHING,
    **options,
) -> StreamingQuery:
    """Run requests arriving: their files with bodies, see ``run_bodies``."""

    def work(batch: DataFrame) -> DataFrame:
        return run_bodies(batch, pages, docs, at, **options)

    return _per_batch(requests, work, out, checkpoint, trigger)


def stream_job_changes(
    changes: DataFrame, out: str, checkpoint: str, trigger: dict = EVERYTHING
) -> StreamingQuery:
    """Job status changes arriving: the last one per job and batch, as a log.

    ``current_jobs`` reads the log. Rewriting the whole job table per batch would cost
    more with every job ever seen.
    """
    return _per_batch(changes, job_latest, out, checkpoint, trigger)


def stream_job_table(
    changes: DataFrame, root: str, checkpoint: str, trigger: dict = EVERYTHING, buckets: int = BUCKETS
) -> StreamingQuery:
    """Job inserts and updates arriving: the current job table in ``root``, see ``plans.jobtable``.

    Each batch rewrites the buckets it touches and no others; ``read_job_table`` reads them. A
    table is fed by one checkpoint and keeps its number of buckets.
    """
    create_job_table(changes.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        apply_changes(root, batch, batch_id, buckets)
        batch.unpersist()

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def current_jobs(spark: SparkSession, log: str) -> DataFrame:
    """The current state of each job in a log of changes."""
    return job_latest(spark.read.parquet(log).drop("batch_id"))


def compact_jobs(spark: SparkSession, log: str, out: str) -> str:
    """A new log with one row per job, to which the feed goes on writing under its old
    checkpoint once it has been stopped and started with ``out``. Returns ``out``."""
    current_jobs(spark, log).write.mode("overwrite").parquet(f"{out}/batch_id=-1")
    return out


def stream_job_dedupe(changes: DataFrame, delay: str, ts: str = "ts", key: str = "job_id") -> DataFrame:
    """One row per job even when the feed replays, for repeats within ``delay``.

    Watermarks need an instant, so a wall-clock ``ts`` is cast and cast back.
    """
    timed = changes.withColumn("event_time", F.col(ts).cast("timestamp"))
    once = timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
    return once.drop("event_time")


def append(rows: DataFrame, out: str, checkpoint: str, trigger: dict = EVERYTHING) -> StreamingQuery:
    """Rows to parquet as they come."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _per_batch(
    feed: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    trigger: dict,
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
