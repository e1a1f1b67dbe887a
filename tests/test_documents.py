"""Paged documents: files, pages, tables, summaries, reports."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagesift.operators import grids, paged, reports, summaries
from pagesift.operators.write import body_lines, write_as
from pagesift.plans.documents import process_and_write, process_docs
from pagesift.schema import DOCUMENTS
from pagesift.sources import pdf

GRID = [["Name", "Note|x"], ["a\nb", None], [None, ""], [" ", None], ["c"]]


@pytest.fixture
def docs(spark):
    def make(*rows):
        full = [
            (n, f"https://d.example.com/{n}.pdf", {"Title": "T"}, pages, tables)
            for n, (pages, tables) in enumerate(rows)
        ]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages /Type /Page /Type\n/Page>>")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.4 \xff")
    (tmp_path / "c.txt").write_bytes(b"/Type /Page")
    counted = pdf.pdf_page_count(pdf.read_pdf_files(spark, str(tmp_path)))
    found = {r.path.rsplit("/", 1)[-1]: r.total_pages for r in counted.collect()}
    assert found == {"a.pdf": 2, "b.PDF": 1}
    with pytest.raises(ValueError, match="Not a PDF"):
        pdf.read_pdf_files(spark, str(tmp_path / "c.txt"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        pdf.read_pdf_files(spark, str(tmp_path / "none.pdf"))


def test_payloads_are_split(spark):
    rows = [("text/html", b"<p>"), ("application/octet-stream", b"%PDF-1"), (None, None), ("x application/PDF", b"")]
    df = spark.createDataFrame(rows, "content_type string, content binary")
    good, bad = pdf.split_valid_pdfs(df)
    assert good.columns == df.columns and good.count() == 2
    assert sorted(r.reason for r in bad.collect()) == [
        "not a PDF, content type ?", "not a PDF, content type text/html",
    ]


def test_pages(docs):
    df = docs((["one", None, " x\t y \n\n\n\nz "], []), ([], []))
    assert [tuple(r) for r in paged.doc_pages(df).orderBy("page_no").collect()] == [
        (0, 1, "one"), (0, 2, ""), (0, 3, " x\t y \n\n\n\nz "),
    ]
    assert [tuple(r) for r in paged.select_pages(df, "3,1").orderBy("page_no").collect()] == [
        (0, 1, "one"), (0, 3, "x y \n\nz"),
    ]
    texts = {r.doc_id: r.full_text for r in paged.doc_full_text(df).collect()}
    assert texts == {0: "[Page 1]\none\n\n[Page 3]\nx y \n\nz", 1: ""}
    with pytest.raises(ValueError, match="Bad page range"):
        paged.select_pages(df, "x")


def _page_rows():
    rows = [(1, n, "x" * (n % 7)) for n in range(1, 3000)] + [(2, 1, "é" * 9000), (2, 2, "y"), (3, 1, " ")]
    rows += [(4, 5000, "late"), (4, 7, "b"), (4, 7, "a"), (4, 7, "a"), (5, 1, None), (None, 1, "no document"), (6, None, "no number")]
    return rows + [(6, n, "\U0001f600" * n) for n in (2, 1, -3)]


def _running(rows, doc):
    mine = sorted((n, t) for d, n, t in rows if d == doc and n is not None and (t or "").strip())
    return "\n\n".join(f"[Page {n}]\n{t}" for n, t in mine)


@pytest.mark.parametrize("limit", [1, 17, 8000, 20_000, 10**9])
def test_leading_text_of_page_rows_equals_the_cut_full_text(spark, limit):
    rows = _page_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, text string")
    for block in (1, 100, 1000):
        found = {r.doc_id: r.text for r in paged.leading_text(df, limit, block).collect()}
        assert found == {doc: _running(rows, doc)[:limit] for doc in (1, 2, 4, 6)}


@pytest.mark.parametrize("size", [1, 10, 4001, 10**6])
def test_chunks_of_page_rows_make_up_the_full_text(spark, size):
    rows = [row for row in _page_rows() if size > 5 or row[0] != 2]
    df = spark.createDataFrame(rows, "doc_id bigint, page_no int, text string")
    for block in (7, 1000):
        chunks = {}
        for r in paged.text_chunks(df, size, block).orderBy("doc_id", "chunk_no").collect():
            chunks.setdefault(r.doc_id, []).append((r.chunk_no, r.text))
        for doc, parts in chunks.items():
            assert "".join(text for _, text in parts) == _running(rows, doc)
            assert [n for n, _ in parts] == list(range(len(parts)))
            assert all(len(text) == size for _, text in parts[:-1]) and 0 < len(parts[-1][1]) <= size
        assert set(chunks) == {row[0] for row in rows} - {None, 3, 5}


def test_chunks_of_a_document_of_a_million_pages_are_spread(spark):
    pages = spark.range(0, 1_000_000, 1, 8).selectExpr("1 as doc_id", "id as page_no", "'text of a page' as text")
    chunks = paged.text_chunks(pages, size=100_000)
    got = chunks.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("most"))
    sizes = [r.n for r in got.collect() if r.n]
    total = sum(len(f"[Page {n}]\ntext of a page\n\n") for n in range(1_000_000)) - 2
    assert sum(sizes) == total and len(sizes) > 1 and max(sizes) < 0.6 * total
    assert chunks.filter("chunk_no = 12").first().text == "".join(
        f"[Page {n}]\ntext of a page\n\n" for n in range(60_000)
    )[1_200_000:1_300_000]


def test_leading_text_leaves_far_pages_behind(spark):
    pages = spark.range(0, 200_000, 1, 4).selectExpr("id % 2 as doc_id", "id div 2 as page_no", "'x' as text")
    near = paged.leading_text(pages)
    plan = near._jdf.queryExecution().executedPlan().toString()
    # The filter of blocks comes before the text is shuffled.
    assert "Subquery" in plan[plan.index("hashpartitioning(doc_id") :]
    assert {r.doc_id: len(r.text) for r in near.collect()} == {0: 8000, 1: 8000}


def test_tables(docs):
    long_cell = "x" * 60
    df = docs(
        ([""], [(1, 0, GRID), (1, 1, [[None, ""]]), (2, 0, [[long_cell], ["y"]]), (2, 1, [["only", "row"]])]),
    )
    rows = grids.doc_tables(df).orderBy("page_no", "table_index").collect()
    assert [(r.page_no, r.table_index, r.headers, r.rows, r.row_count, r.col_count) for r in rows] == [
        (1, 0, ["Name", "Note|x"], [["a b", ""], ["", ""], ["c"]], 3, 2),
        (2, 0, None, [[long_cell], ["y"]], 2, 1),
        (2, 1, None, [["only", "row"]], 1, 2),
    ]
    bodies = [r.body for r in grids.tables_markdown(grids.doc_tables(df)).orderBy("page_no", "table_index").collect()]
    assert bodies[0] == (
        "### Page 1, Table 1\n\n| Name | Note|x |\n|---|---|\n| a b |  |\n|  |  |\n| c |  |\n"
    )
    assert bodies[2] == "### Page 2, Table 2\n\n| Col 1 | Col 2 |\n|---|---|\n| only | row |\n"


def test_table_lines_and_frames(docs):
    df = docs(([""], [(1, 0, [["a", 'q"x'], ["1", "2,3"], [""], ["", "z"]])]))
    tables = grids.doc_tables(df)
    lines = [r.line for r in grids.tables_csv_rows(tables).orderBy("seq").collect()]
    assert lines == ["# Page 1 — Table 1", 'a,"q""x"', '1,"2,3"', ",z", ""]
    frame = grids.table_frame(tables, 0, 1, 0).orderBy("row_no").toPandas()
    assert list(frame.columns) == ["row_no", "a", 'q"x']
    assert frame["a"].tolist() == ["1", ""]
    with pytest.raises(ValueError, match="No table"):
        grids.table_frame(tables, 0, 9, 0)


def test_operations_plan_only_what_they_need(docs):
    df = docs((["a", "b"], [(1, 0, GRID), (2, 0, GRID)]))
    done = process_docs(df, "tables", "2").first()
    assert done.text_pages == [] and [t.page_no for t in done.tables] == [2] and done.summary == ""
    done = process_docs(df, "extract").first()
    assert len(done.text_pages) == 2 and done.tables == [] and done.summary == ""
    done = process_docs(df, "summarize").first()
    assert len(done.text_pages) == 2 and done.tables == [] and done.summary.startswith("[")
    plan = process_docs(df, "tables")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "[Page " not in plan  # no page text is touched
    with pytest.raises(ValueError, match="Unknown op"):
        process_docs(df, "print")


def test_summaries(docs):
    df = docs((["long text"], []), ([" "], []), ([], []), (["fail"], []))

    def fn(prompt):
        if "fail" in prompt:
            raise RuntimeError("no")
        return prompt.replace("\n", "/")

    done = process_docs(df, "summarize", prompt="Do:", fn=fn).orderBy("doc_id").collect()
    assert [r.summary for r in done] == [
        "Do://Document text:/[Page 1]/long text",
        "[No text content found to summarize.]",
        "",
        "[Summarization failed: no]",
    ]
    flags = [r.has_summary for r in reports.doc_result_summary(process_docs(df, "all", fn=fn)).orderBy("doc_id").collect()]
    assert flags == [True, False, False, False]


def test_has_summary(values):
    assert values(summaries.has_summary, ["x", "", None, " [x]", "x]"]) == [True, False, False, False, True]


def test_prompt(values):
    short, custom = values(summaries.summary_prompt, ["é" * 9000, ""])
    assert short.endswith("\n\nDocument text:\n" + "é" * 8000)
    assert custom.startswith("Summarize this document concisely.")
    assert values(lambda c: summaries.summary_prompt(c, "Do"), ["x"]) == ["Do\n\nDocument text:\nx"]


def report(docs, fmt, summary="All fine."):
    df = docs((["Text one", "  "], [(1, 0, GRID)]), ([], []))
    done = process_docs(df).withColumn("summary", F.lit(summary))
    return [r.body for r in reports.render_docs(done, fmt, "now").orderBy("doc_id").collect()]


def test_text_report(docs):
    full, empty = report(docs, "txt")
    assert full.split("\n")[3:] == [
        "File:       https://d.example.com/0.pdf",
        "Operation:  all",
        "Pages:      all",
        "Generated:  now",
        "=" * 60,
        "",
        "── AI SUMMARY ──",
        "",
        "All fine.",
        "",
        "── EXTRACTED TEXT ──",
        "",
        "--- Page 1 ---",
        "Text one",
        "",
        "--- Page 2 ---",
        "(no text on this page)",
        "",
        "── TABLES ──",
        "",
        "[Page 1, Table 1]",
        "  Name | Note|x",
        "  -----+-------",
        "  a b | ",
        "   | ",
        "  c",
    ]
    assert "EXTRACTED" not in empty and "TABLES" not in empty


def test_markdown_report(docs):
    full, empty = report(docs, "md", summary="")
    assert "AI Summary" not in full
    assert "## Extracted Text\n\n### Page 1\n\nText one\n\n### Page 2\n\n_No text detected" in full
    assert full.endswith("| c |  |\n")
    assert empty.endswith("| Generated | `now` |\n")


def test_json_report(docs):
    full, empty = report(docs, "json", summary="")
    data = json.loads(full)
    assert data["summary"] is None
    assert data["text_pages"] == {"1": "Text one", "2": ""}
    assert data["tables"][0]["headers"] == ["Name", "Note|x"]
    assert list(data["tables"][0])[:2] == ["page", "table_index"]
    assert data["metadata"]["total_pages"] == 2
    assert json.loads(empty)["text_pages"] == {}


def test_row_report(docs):
    df = docs((["Text, one"], [(1, 0, [["a", "b"], ["1", "2"]])]))
    done = process_docs(df).withColumn("summary", F.lit("S"))
    lines = [r.line for r in reports.doc_report_rows(done).orderBy("seq").collect()]
    assert lines == [
        '"# Page 1, Table 1"', "a,b", "1,2", "", "# Extracted Text", "page,text", '1,"Text, one"',
        "# AI Summary", "S",
    ]


def test_writing(docs, tmp_path, spark):
    df = docs((["Text"], [(1, 0, GRID)]))
    for fmt in ("json", "csv", "txt", "md"):
        out = process_and_write(df, "all", fmt, str(tmp_path / "a" / fmt), "now")
        (row,) = spark.read.parquet(out).collect()
        assert "Text" in row.body and row.doc_id == df.first().doc_id
    lines = [r.line for r in reports.doc_report_rows(process_docs(df, "all")).orderBy("seq").collect()]
    csv = spark.read.parquet(str(tmp_path / "a" / "csv"))
    assert csv.first().body.split("\n") == "\n".join(lines).split("\n")
    assert [r.line_no for r in body_lines(csv).collect()] == list(range(len("\n".join(lines).split("\n"))))
    tables = write_as(grids.doc_tables(df), "csv", str(tmp_path / "tables"))
    back = spark.read.csv(tables, header=True, escape='"').first()
    assert json.loads(back.headers) == ["Name", "Note|x"]
    with pytest.raises(ValueError, match="Unknown format"):
        write_as(df, "xlsx", str(tmp_path / "x"))
    with pytest.raises(ValueError, match="body"):
        write_as(df, "md", str(tmp_path / "x"))


def test_pandas_is_a_helper_only():
    batch = pd.DataFrame({"summary": ["p", None]})
    (answered,) = summaries._answer(iter([batch]), lambda p: p.upper())
    assert answered["summary"].tolist() == ["P", "[No text content found to summarize.]"]
