"""What Spark plans: extraction is narrow, scans are pruned, joins see slim sides."""

import pytest

from pagesift.catalog import ORACLES, QUERIES
from pagesift.operators import extract as X
from pagesift.plans import runs
from pagesift.plans.documents import process_docs
from pagesift.schema import DOCUMENTS

REQUESTS_ASKED = "request_id bigint, url string, scrape_mode string, follow_pdfs boolean, pdf_op string, pdf_format string"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Pages and documents as parquet tables."""
    root = tmp_path_factory.mktemp("stored")
    spark.range(10).selectExpr("id as page_id", "'https://a.example.com/' || id as url", "'<p>x' as html").write.parquet(f"{root}/pages")
    spark.createDataFrame([(1, "u", {}, ["t"], [])], DOCUMENTS).write.parquet(f"{root}/docs")
    return spark.read.parquet(f"{root}/pages"), spark.read.parquet(f"{root}/docs")


@pytest.mark.parametrize("mode", X.MODES)
def test_extraction_never_shuffles(stored, mode):
    plan = physical(X.extract(stored[0], mode, selector="p"))
    assert "Exchange" not in plan
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["links", "text_blocks", "images", "html_tables", "meta_tags", "headings"])
def test_exploded_views_compute_the_array_once(stored, name):
    plan = physical(getattr(X, name)(stored[0]))
    assert "Exchange" not in plan and "(size(transform" not in plan and "size(filter" not in plan


def test_elements_are_counted_in_the_row(stored):
    plan = physical(X.node_counts(stored[0]))
    assert "Exchange" not in plan and plan.count("array_distinct") == 1


def test_document_work_never_shuffles_and_reads_only_its_columns(stored):
    plan = physical(process_docs(stored[1], "all", "1-3"))
    assert "Exchange" not in plan
    slim = physical(process_docs(stored[1], "extract"))
    assert "grids" not in slim.split("ReadSchema")[1]


def test_link_lookup_reads_urls_only(stored):
    links = runs.pdf_links(X.links(stored[0]))
    plan = physical(runs.follow_links(links, stored[1]))
    schemas = [part.split(">")[0] for part in plan.split("ReadSchema: ")[1:]]
    assert any("doc_id" in s and "pages" not in s for s in schemas)


def test_links_of_runs_are_resolved_once(spark, stored):
    asked = spark.createDataFrame([(1, "https://a.example.com/1", "all", True, "all", "md")], REQUESTS_ASKED)
    plan = physical(runs.pdf_worklist(asked, stored[0]))
    assert plan.count("javascript:") == 1


def test_titles_need_no_other_nodes(stored):
    plan = physical(X.page_titles(stored[0]))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan


def test_catalogue_is_complete():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if n.startswith("op") or n == "pipeline"]
