"""Job history, keys, links to documents, runs, feeds."""

import csv
import datetime as dt
import io
import json

import pytest
from pyspark.sql import functions as F

from pagesift.operators import jobs, render, reports
from pagesift.operators.extract import extract
from pagesift.plans import runs
from pagesift.plans.documents import process_docs
from pagesift.plans.scratch import scratch_path, written
from pagesift.plans.skew import split_hot_keys_join
from pagesift.schema import DOCUMENTS, JOBS
from pagesift.sources.requests import accepted_requests, rejected_requests
from pagesift.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def job_table(spark):
    rows = [
        (1, 1, "scrape", "SUCCESS", '{"a":1}', '{"r":1}', None, at(0), at(1)),
        (2, 2, "pdf", "PENDING", None, None, "e", at(0), at(0)),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_upsert(spark, job_table):
    new = spark.createDataFrame(
        [(1, "pdf", "PENDING", '{"b":2}', at(5), 10), (3, "scrape", "A", None, at(6), 11), (3, "scrape", "B", None, at(7), 12)],
        "job_id bigint, job_type string, status string, request_json string, ts timestamp_ntz, seq bigint",
    )
    done = jobs.upsert_jobs(job_table, new)
    assert done.columns == job_table.columns
    rows = {r.job_id: tuple(r) for r in done.collect()}
    assert rows == {
        1: (12, 1, "pdf", "PENDING", '{"b":2}', None, None, at(0), at(5)),
        2: (2, 2, "pdf", "PENDING", None, None, "e", at(0), at(0)),
        3: (14, 3, "scrape", "B", None, None, None, at(6), at(7)),
    }
    recent = jobs.recent_jobs(done, 2)
    decoded = recent.select("job_id", F.try_variant_get("request", "$.b", "int").alias("b")).collect()
    assert [tuple(r) for r in decoded] == [(3, None), (1, 2)]


def test_update(spark, job_table):
    changes = spark.createDataFrame(
        [(2, "FAILURE", None, "x", at(3), 1), (2, "SUCCESS", '{"ok":true}', None, at(4), 2), (9, "S", None, None, at(4), 3)],
        "job_id bigint, status string, result_json string, error_text string, ts timestamp_ntz, seq bigint",
    )
    done = jobs.update_jobs(job_table, changes)
    rows = {r.job_id: (r.id, r.status, r.result_json, r.error_text, r.updated_at) for r in done.collect()}
    assert rows == {1: (1, "SUCCESS", '{"r":1}', None, at(1)), 2: (2, "SUCCESS", '{"ok":true}', None, at(4))}


def test_keys(spark):
    keys = spark.createDataFrame([("a", True), ("b", False)], "name string, is_active boolean").select(
        F.sha2(F.col("name").cast("binary"), 256).alias("key_hash"), "is_active"
    )
    uses = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "api_key string, ts int")
    assert sorted(r.ts for r in jobs.active_only(uses, keys).collect()) == [1, 4]
    assert [r.last_used_at for r in jobs.key_last_used(uses, keys).collect()] == [4]
    assert jobs.active_key_count(keys).first().asDict() == {"n": 1, "has_keys": True}
    more = jobs.insert_if_absent(keys, keys.unionByName(keys.withColumn("key_hash", F.lit("z"))), "key_hash")
    assert more.count() == 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_are_dealt_out_and_nothing_is_lost(spark, how):
    big = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = big.join(small, "k", how)
    dealt = split_hot_keys_join(big, small, "k", how, splits=6, hot_rows=5000)
    assert dealt.columns == plain.columns
    assert dealt.exceptAll(plain).count() == 0 and plain.exceptAll(dealt).count() == 0


def test_hot_rows_land_in_several_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = spark.range(8000).select((F.col("id") % 1).alias("k"), F.col("id").alias("v"))
        small = spark.createDataFrame([(0, "x")], "k bigint, w string")
        plain = big.join(small, "k").select(F.spark_partition_id()).distinct().count()
        dealt = split_hot_keys_join(big, small, "k", splits=8, hot_rows=1000)
        assert plain == 1
        assert dealt.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


HTML = """<a href="/x.pdf">x</a><a href="/x.pdf">again</a><a href="y.PDF">y</a><a href="/z.pdf?q">z</a>"""
REQUEST = (
    "request_id bigint, url string, scrape_mode string, scrape_format string, follow_pdfs boolean, "
    "pdf_op string, pdf_format string"
)
REQUESTS = [
    (1, "https://p.example.com/a", "all", "json", True, "all", "md"),
    (2, "https://p.example.com/a", "links", "md", False, "all", "md"),
    (3, "https://p.example.com/a", "essential", "txt", True, "all", "md"),
    (4, "https://p.example.com/a", "custom", "json", True, "all", "md"),
    (5, "https://p.example.com/x.pdf?v=1", "all", "json", True, "tables", "csv"),
    (6, "https://p.example.com/gone", "all", "json", True, "all", "md"),
    (7, "https://p.example.com/a", "odd", "json", False, "all", "md"),
    (8, "https://p.example.com/a", "links", "json", True, "extract", "txt"),
]


@pytest.fixture
def world(spark, pages):
    docs = spark.createDataFrame(
        [
            (1, "https://p.example.com/x.pdf", {}, ["t"], []),
            (2, "https://p.example.com/x.pdf?v=1", {}, ["t"], []),
        ],
        DOCUMENTS,
    )
    return spark.createDataFrame(REQUESTS, REQUEST), pages(("https://p.example.com/a", HTML)), docs


def test_runs(world):
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    manifest = {r.request_id: r for r in runs.run_requests(*world, stamp).collect()}
    shown = {
        n: ([(o.type, o.file, o.source.rsplit("/", 1)[-1]) for o in r.outputs], r.errors)
        for n, r in manifest.items()
    }
    assert manifest[1].started_at == manifest[1].completed_at == "2024-05-06T07:08:09"
    pdfs = [("pdf", f"1/pdf/{n}_x_all_20240506_070809.md", "x.pdf") for n in (0, 1)]
    assert shown == {
        1: ([("scrape", "1/scraped_all_20240506_070809.json", "a"), *pdfs], []),
        2: ([("scrape", "2/scraped_links_20240506_070809.md", "a")], []),
        3: ([("scrape", "3/scraped_essential_20240506_070809.txt", "a")], []),
        4: ([], ["scrape: CSS selector required for mode='custom'"]),
        5: ([("pdf", "5/pdf/0_x_tables_20240506_070809.csv", "x.pdf?v=1")], ["scrape: page not found"]),
        6: ([], ["scrape: page not found"]),
        7: ([], ["scrape: Unknown mode 'odd'"]),
        8: (
            [("scrape", "8/scraped_links_20240506_070809.json", "a")]
            + [("pdf", f"8/pdf/{n}_x_extract_20240506_070809.txt", "x.pdf") for n in (0, 1)],
            [],
        ),
    }


def test_stored_links_give_the_same_runs_and_markup_meets_no_join(world):
    requests, pages, docs = world
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    stored = written(runs.page_pdf_links(pages), "links")
    plain = runs.run_requests(requests, pages, docs, stamp)
    assert sorted(map(str, plain.collect())) == sorted(
        map(str, runs.run_requests(requests, pages, docs, stamp, links=stored).collect())
    )
    moved = False
    for line in plain._jdf.queryExecution().executedPlan().toString().splitlines():
        # Lines from a parse on downwards are below it until the next branch of the plan.
        assert not (("Exchange" in line or "Join" in line) and "html" in line), line
        moved = moved or "MapInArrow" in line
    assert moved


def test_compacted_log_has_the_same_jobs(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "compact")
    schema = "job_id bigint, status string, ts timestamp_ntz, seq bigint"
    rows = [(1, "a", at(0), 1), (2, "b", at(1), 2), (1, "c", at(2), 3)]
    spark.createDataFrame(rows[:2], schema).write.parquet(f"{log}/batch_id=0")
    spark.createDataFrame(rows[2:], schema).write.parquet(f"{log}/batch_id=1")
    before = sorted(map(tuple, feeds.current_jobs(spark, log).collect()))
    feeds.compact_jobs(spark, log, out)
    assert sorted(map(tuple, feeds.current_jobs(spark, out).collect())) == before
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(2, "d", at(9), 9)], schema).write.parquet(f"{out}/batch_id=2")
    assert {r.job_id: r.status for r in feeds.current_jobs(spark, out).collect()} == {1: "c", 2: "d"}


def test_bad_requests_are_told_apart(spark):
    payloads = [
        '{"url":"u","delay":"abc","follow_pdfs":"maybe"}',
        '{"url":"u","delay":"1.5","follow_pdfs":"on"}',
        "{",
        "[1]",
        '{"delay":1}',
        '{"url":5,"scrape_mode":null,"ai_prompt":null}',
        None,
        '{"url":"u","pdf_op":{"a":1},"delay":true,"follow_pdfs":1}',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    rejected = {r.id: r.reasons for r in rejected_requests(df, "run").collect()}
    unreadable = ["payload: not a JSON object"]
    assert rejected == {
        0: ["follow_pdfs: not a boolean", "delay: not a double"],
        2: unreadable,
        3: unreadable,
        4: ["url: missing"],
        5: ["url: not a string", "scrape_mode: not a string"],
        6: unreadable,
        7: ["pdf_op: not a string"],
    }
    kept = accepted_requests(df, "run").collect()
    assert [(r.id, r.url, r.delay, r.follow_pdfs, r.ai_prompt) for r in kept] == [(1, "u", 1.5, True, None)]
    assert rejected_requests(df.limit(0), "scrape").count() == 0


def test_manifest_and_extraction_are_written(world, tmp_path, spark):
    requests, pages, docs = world
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    out = runs.write_manifest(runs.run_requests(requests, pages, docs, stamp), str(tmp_path / "m"))
    assert sorted(json.loads(r.value)["request_id"] for r in spark.read.text(out).collect()) == list(range(1, 9))
    for fmt in ("json", "csv", "txt", "md"):
        written_to = runs.extract_and_write(pages, "links", fmt, str(tmp_path / fmt), "now")
        (row,) = spark.read.parquet(written_to).collect()
        assert (row.page_id, row.url) == (0, "https://p.example.com/a") and "again" in row.body
    with pytest.raises(ValueError, match="Unknown format"):
        runs.extract_and_write(pages, "links", "xlsx", str(tmp_path / "x"), "now")


def test_files_of_runs_have_the_bodies_of_their_pages_and_documents(world, spark):
    requests, pages, docs = world
    stamp, time = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), "2024-05-06T07:08:09"
    requests = requests.withColumn("ai_prompt", F.concat(F.lit("prompt "), "request_id"))
    twice = requests.filter("request_id = 8").withColumns({"request_id": F.lit(9), "pdf_format": F.lit("odd")})
    none = requests.filter("request_id = 8").withColumns({"request_id": F.lit(10), "pdf_op": F.lit("odd")})
    requests = requests.union(twice).union(none)
    files = runs.run_bodies(requests, pages, docs, stamp, fn=lambda prompt: prompt.split("\n")[0])
    listed = runs.run_outputs(requests, pages, docs, stamp).filter("file is not null")
    assert sorted(r.file for r in files.collect()) == sorted(r.file for r in listed.collect())
    bodies = {(r.request_id, r.seq): r.body for r in files.collect()}
    for n, mode, fmt in ((1, "all", "json"), (2, "links", "md"), (3, "essential", "txt"), (8, "links", "json")):
        expected = render.page_bodies(extract(pages, mode), mode, fmt, time).first().body
        assert bodies[n, -1] == expected
    assert bodies[9, -1] == bodies[8, -1] == bodies[10, -1]
    assert (9, 0) not in bodies and (10, 0) not in bodies
    assert "prompt 1" in bodies[1, 0] and bodies[1, 0] == bodies[1, 1]
    for n, url, op, fmt in ((5, "https://p.example.com/x.pdf?v=1", "tables", "csv"), (8, "https://p.example.com/x.pdf", "extract", "txt")):
        done = process_docs(docs.filter(F.col("url") == url), op)
        assert bodies[n, 0] == reports.doc_bodies(done, fmt, time).first().body
    nothing = runs.run_bodies(requests.filter("request_id in (4, 6)"), pages, docs, stamp)
    assert nothing.columns == files.columns and nothing.count() == 0


@pytest.mark.parametrize("mode", ["links", "images", "tables", "all", "essential"])
def test_csv_bodies_hold_the_csv_rows(pages, mode):
    html = HTML + '<title>a "b", c</title><img src="/i.png"><table><tr><td>1<td>2</table><p>para'
    extracted = extract(pages(("https://p.example.com/a", html), ("https://p.example.com/b", "")), mode)
    rows = render.page_csv_rows(extracted, mode)
    fields = [c for c in rows.columns if c not in ("page_id", "pos")]
    expected = {0: [], 1: []}
    for row in rows.collect():
        expected[row.page_id].append([row[f] or "" for f in fields])
    for row in render.page_csv(extracted, mode).collect():
        head, *found = csv.reader(io.StringIO(row.body))
        assert head == fields
        assert sorted(found) == sorted(expected[row.page_id])


def test_links_without_a_landed_document(world):
    _, pages, docs = world
    from pagesift.operators.extract import links

    found = runs.pdf_links(links(pages))
    assert [r.href for r in runs.unresolved_links(found, docs).collect()] == ["https://p.example.com/y.PDF"]
    assert runs.follow_links(found, docs).count() == 2
    assert runs.follow_links(found, docs, splits=4).count() == 2


def test_scratch_is_under_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root)
    df = written(spark.range(3), "ids")
    assert df.count() == 3 and root in df.inputFiles()[0]


def test_feed_in_two_batches_equals_batch(spark, tmp_path, world):
    requests, pages, docs = world
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n, part in enumerate((requests.filter("request_id < 4"), requests.filter("request_id >= 4"))):
        part.coalesce(1).write.mode("append").parquet(source)
        feed = feeds.read_feed(spark, source, REQUEST)
        feeds.stream_runs(feed, pages, docs, stamp, out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).select("batch_id").distinct().count() == n + 1
    batch = runs.run_requests(requests, pages, docs, stamp)
    streamed = spark.read.parquet(out).drop("batch_id")
    key = lambda r: r.request_id
    assert sorted(streamed.collect(), key=key) == sorted(batch.collect(), key=key)


CHANGES = "job_id bigint, status string, ts timestamp_ntz, seq bigint"


def test_job_feed_keeps_the_latest_over_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in ([(1, "A", at(1), 1), (2, "A", at(1), 2), (1, "B", at(2), 3)], [(2, "C", at(9), 4), (1, "OLD", at(0), 5)]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        feeds.stream_job_changes(feeds.read_feed(spark, source, CHANGES), out, checkpoint).awaitTermination()
    assert sorted((r.job_id, r.status) for r in feeds.current_jobs(spark, out).collect()) == [(1, "B"), (2, "C")]


def test_replayed_jobs_are_dropped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for rows in ([(1, "A", at(1), 1), (1, "A", at(1), 1), (2, "A", at(1), 2)], [(2, "A", at(1), 2), (3, "A", at(2), 3)]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(source)
        feed = feeds.read_feed(spark, source, CHANGES)
        feeds.append(feeds.stream_job_dedupe(feed, "10 minutes"), out, checkpoint).awaitTermination()
    assert sorted(r.job_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("mode", ["links", "all", "essential"])
def test_page_feed_equals_batch(spark, tmp_path, world, mode):
    from pagesift.operators.extract import explode_items, extract

    _, pages, _ = world
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    pages.write.parquet(source)
    feeds.stream_extract(feeds.read_feed(spark, source, pages.schema), mode, out, checkpoint).awaitTermination()
    batch = extract(pages, mode)
    batch = batch if mode in ("all", "essential") else explode_items(batch)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))


def test_hot_keys_of_any_number_join_as_in_a_plain_join(spark):
    from pagesift.plans.skew import split_hot_keys_join

    big = spark.range(9000).selectExpr("id", "if(id % 10 = 0, null, id % 3000) as key")
    small = spark.range(100, 4000).selectExpr("id as key", "id * 2 as twice")
    for how in ("inner", "left", "left_semi", "left_anti"):
        split = split_hot_keys_join(big, small, "key", how, splits=3, hot_rows=2)
        plain = big.join(small, "key", how)
        assert sorted(map(repr, split.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_video_records_are_in_every_export(spark):
    from pagesift.operators.render import page_csv_rows, page_md, page_txt

    schema = (
        "page_id bigint, url string, digest struct<url: string, title: string, description: string, "
        "main_text: string, pdf_links: array<string>>, video struct<video_id: string, view_count: bigint, is_live: boolean>"
    )
    rows = [
        (1, "u1", ("u1", "Title", "Text", "Main", ["a.pdf", "b.pdf"]), None),
        (2, "u2", None, ("v1", 7, True)),
    ]
    both = spark.createDataFrame(rows, schema)
    cells = {(r.page_id, r.pos, r.section, r.value) for r in page_csv_rows(both, "essential").collect()}
    assert cells == {
        (1, 0, "url", "u1"),
        (1, 1, "title", "Title"),
        (1, 2, "description", "Text"),
        (1, 3, "main_text", "Main"),
        (1, 4, "pdf_links", "a.pdf"),
        (1, 5, "pdf_links", "b.pdf"),
        (2, 0, "video_id", "v1"),
        (2, 1, "view_count", "7"),
        (2, 2, "is_live", "True"),
    }
    txt = {r.page_id: r.body for r in page_txt(both, "essential", "now").collect()}
    assert "--- VIEW_COUNT ---\n  7\n" in txt[2] and "VIDEO_ID" not in txt[1] and "PDF_LINKS" not in txt[2]
    md = {r.page_id: r.body for r in page_md(both, "essential", "now").collect()}
    assert "## Is Live\nTrue\n" in md[2] and "## Pdf Links\n- a.pdf\n- b.pdf" in md[1]


def test_requests_wait_for_their_page_and_then_err(spark, tmp_path):
    """Pages before, within and after the delay, over several runs of the feed."""
    requests, pages, out, checkpoint = (str(tmp_path / n) for n in ("requests", "pages", "out", "check"))
    asked_schema = "request_id bigint, url string, asked_at timestamp"
    landed_schema = "page_id bigint, url string, landed_at timestamp"
    minute = [dt.datetime(2024, 5, 6, 12) + dt.timedelta(minutes=m) for m in range(200)]
    rounds = [
        ([(1, "a", minute[10]), (2, "b", minute[10]), (3, "c", minute[11]), (4, None, minute[11])], [(1, "a", minute[0])]),
        ([], [(2, "b", minute[18])]),
        ([(8, "x", minute[60])], [(8, "x", minute[60])]),
        ([(9, "c", minute[61])], [(3, "c", minute[62])]),
        ([(99, "end", minute[199])], [(99, "end", minute[199])]),
    ]
    answered = []
    for asked, landed in rounds:
        spark.createDataFrame(asked, asked_schema).coalesce(1).write.mode("append").parquet(requests)
        spark.createDataFrame(landed, landed_schema).coalesce(1).write.mode("append").parquet(pages)
        rows = feeds.stream_awaited_pages(
            feeds.read_feed(spark, requests, asked_schema), feeds.read_feed(spark, pages, landed_schema), "10 minutes", "1 hour"
        )
        feeds.append(rows, out, checkpoint).awaitTermination()
        found = spark.read.parquet(out).collect() if (tmp_path / "out").exists() else []
        answered.append({(r.request_id, r.page_id, r.error) for r in found})
    late = "scrape: page not found"
    assert answered[0] == {(1, 1, None)} and answered[1] == {(1, 1, None), (2, 2, None)}
    # The page of request 3 came when its time was over; the later request 9 takes it.
    assert answered[4] >= {(1, 1, None), (2, 2, None), (3, None, late), (4, None, late), (8, 8, None), (9, 3, None)}
    assert len([a for a in answered[4] if a[0] != 99]) == 6
