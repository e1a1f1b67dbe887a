"""Bodies of runs in one pass: equal to one pass each, whatever is asked of whom."""

import itertools

import pytest
from pyspark.sql import functions as F

from pagesift.operators.extract import MODES, extract, extract_asked
from pagesift.operators.render import page_bodies
from pagesift.operators.reports import doc_bodies
from pagesift.plans import runs
from pagesift.plans.documents import process_docs
from pagesift.schema import DOC_OPS, DOCUMENTS, FORMATS

NAMED = [m for m in MODES if m != "custom"]
TIME = "2024-05-06T07:08:09"
HTML = [
    "<title>A<style>x</style></title><h1>One <b>two</b></h1><p>p<noscript><p>hidden <a href='n.pdf'>n</a></p></noscript>",
    "<ul><li><p>a</p><li>b</ul><a href='d.pdf'>doc</a><img src=i.png alt=i><meta name=description content=' d '>",
    "<table><caption>c</caption><tr><th>h<th>i<tr><td>1<td><table><tr><td>n</table></table><iframe><h2>no</h2></iframe>",
    "",
    None,
    '<script>var ytInitialPlayerResponse = {"videoDetails":{"videoId":"v","title":"t","viewCount":"7"}};</script><p>text',
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(n, f"https://p.example.com/{n}/", html) for n, html in enumerate(HTML[:-1])]
    rows.append((5, "https://www.youtube.com/watch?v=1", HTML[-1]))
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def docs(spark):
    grid = [(1, 0, [["a", "b"], ["1", "2"], [None, ""]])]
    rows = [
        (1, "https://d.example.com/1.pdf", {"Title": "t"}, ["one", " ", "three  x"], grid),
        (2, "https://d.example.com/2.pdf", {}, [], []),
        (3, "https://d.example.com/3.pdf", {}, [" "], []),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def files_of(spark, rows):
    made = spark.createDataFrame(rows, "type string, kind string, format string, source string, prompt string")
    return made.withColumn("what", F.to_json(F.struct(*made.columns)))


def asked_of_pages(pages):
    """Every page is asked a share of all pairs, some all of them."""
    urls = [r.url for r in pages.select("url").collect()]
    pairs = list(itertools.product(NAMED, FORMATS))
    return [
        ("scrape", mode, fmt, url, None)
        for k, url in enumerate(urls)
        for n, (mode, fmt) in enumerate(pairs)
        if k in (0, 5) or (n + k) % 3 == 0
    ]


def test_bodies_of_pages_equal_those_of_single_passes(spark, pages, docs):
    asked = asked_of_pages(pages)
    got = {r.what: r.body for r in runs.rendered_files(files_of(spark, asked * 2), pages, docs, TIME).collect()}
    expected = {}
    for mode, fmt in itertools.product(NAMED, FORMATS):
        for r in page_bodies(extract(pages, mode), mode, fmt, TIME).collect():
            expected[mode, fmt, r.url] = r.body
    named = {r.what: (r.kind, r.format, r.source) for r in files_of(spark, asked).collect()}
    assert len(got) == len(asked) and {named[what]: body for what, body in got.items()} == {
        key: expected[key] for key in named.values()
    }


def test_bodies_of_documents_equal_those_of_single_passes(spark, pages, docs):
    pairs = [(op, fmt, None) for op in DOC_OPS for fmt in FORMATS]
    pairs += [("summarize", "json", "Short:"), ("all", "md", "Short:"), ("all", "txt", "Long:"), ("all", "csv", "")]
    urls = [r.url for r in docs.select("url").collect()]
    asked = [("pdf", op, fmt, url, p) for url in urls for op, fmt, p in pairs]

    def fn(prompt):
        if prompt.startswith("Long"):
            raise RuntimeError("no")
        return prompt.split("\n")[0] + "!"

    for model in (None, fn):
        files = files_of(spark, asked)
        got = {r.what: r.body for r in runs.rendered_files(files, pages, docs, TIME, model).collect()}
        named = {(r.kind, r.format, r.source, r.prompt): r.what for r in files.collect()}
        for op, fmt, prompt in pairs:
            done = process_docs(docs, op, prompt=prompt, fn=model)
            for doc, body in zip(docs.orderBy("doc_id").collect(), doc_bodies(done, fmt, TIME).orderBy("doc_id").collect(), strict=True):
                assert got[named[op, fmt, doc.url, prompt]] == body.body, (op, fmt, prompt, doc.url)


def test_a_document_with_very_many_reports_has_several_rows(spark, pages, docs):
    asked = [("pdf", "summarize", "json", "https://d.example.com/1.pdf", f"prompt {n}") for n in range(300)]
    got = runs.rendered_files(files_of(spark, asked), pages, docs, TIME, lambda p: p.split("\n")[0]).collect()
    assert len(got) == 300 and len({r.body for r in got}) == 300


def test_one_walk_over_pages_and_one_scan_of_documents_whatever_the_pairs(spark, pages, docs, tmp_path):
    pages.write.parquet(str(tmp_path / "pages"))
    docs.write.parquet(str(tmp_path / "docs"))
    pages, docs = (spark.read.parquet(str(tmp_path / name)) for name in ("pages", "docs"))
    asked = asked_of_pages(pages) + [("pdf", op, fmt, "https://d.example.com/1.pdf", None) for op in DOC_OPS for fmt in FORMATS]
    plan = runs.rendered_files(files_of(spark, asked), pages, docs, TIME)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    schemas = [part.split("\n")[0] for part in plan.split("ReadSchema: ")[1:]]
    assert sum("html" in s for s in schemas) == 1 and sum("grids" in s for s in schemas) == 1


def test_only_asked_modes_are_made(spark, pages):
    asked = pages.withColumn("asked", F.when(F.col("page_id") == 0, F.array(F.lit("links"))).otherwise(F.array().cast("array<string>")))
    rows = {r.page_id: r for r in extract_asked(asked, ["links", "essential"]).collect()}
    assert rows[0].links is not None and rows[0].essential is None
    assert rows[1].links is None and rows[5].essential is None
