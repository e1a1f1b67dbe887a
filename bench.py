"""Time the headline queries: one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the cores. Each query runs once to
warm up and then BENCH_RUNS times; the best run counts. Results go to a sink that
discards them, so whole results are computed and none pass through the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pagesift.catalog import QUERIES

HEADLINE = (
    "pages_scan",
    "node_counts",
    "links",
    "text_blocks",
    "paragraphs",
    "page_digest",
    "page_record_counts",
    "flatten_sections",
    "links_markdown",
    "select_descendant",
    "html_table_cells",
    "images",
    "video_metadata",
    "resolve_url",
    "page_range",
    "doc_full_text",
    "summary_prompts",
    "process_docs",
    "doc_tables",
    "table_rows_long",
    "tables_markdown",
    "doc_report_md",
    "followed_docs",
    "run_manifest",
    "jobs_upsert",
    "job_latest",
    "authorised_events",
    "stream_links",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagesift-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites in error messages cost a round trip per column expression.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(runs)), 3)
    line = {
        "metric": "total wall time of the headline queries, best of runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
