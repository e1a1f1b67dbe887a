"""Scalar functions against plain Python."""

import hashlib
import re
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.functions import pageranges, text, urls

SPARK = settings(
    max_examples=6,
    deadline=None,
    # Each example is a Spark job over many values: no time to shrink a failing one.
    phases=[Phase.explicit, Phase.generate],
    suppress_health_check=list(HealthCheck),
)
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       　"
TEXTS = st.lists(st.text(alphabet=SPACES + "ab​é", max_size=15), min_size=100, max_size=150)


@SPARK
@given(TEXTS)
def test_clean_ws(values, inputs):
    assert values(text.clean_ws, inputs) == [re.sub(r"\s+", " ", x).strip() for x in inputs]


@SPARK
@given(TEXTS)
def test_strip(values, inputs):
    assert values(text.strip, inputs) == [x.strip() for x in inputs]


@SPARK
@given(TEXTS)
def test_clean_cell(values, inputs):
    assert values(text.clean_cell, inputs) == [x.replace("\n", " ").strip() for x in inputs]


@SPARK
@given(TEXTS)
def test_normalise_page(values, inputs):
    def plain(x):
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip()

    assert values(text.normalise_page, inputs) == [plain(x) for x in inputs]


def test_cells(values):
    assert values(text.clean_cell, [None, "a\n b "]) == ["", "a  b"]
    assert values(lambda c: text.md_cell(c, 4), ["a|b|c", None]) == ["a\\|b", ""]
    assert values(text.section_title, ["http_equiv", "links"]) == ["Http Equiv", "Links"]
    assert values(text.hash_key, ["é"]) == [hashlib.sha256("é".encode()).hexdigest()]
    assert values(text.bool_cell, [True, False], "boolean") == ["True", "False"]


def test_first_filled(values):
    pick = lambda c: text.first_filled(c, F.lit(""), F.lit("z"))
    assert values(pick, ["a", "", None]) == ["a", "z", "z"]


def test_rows_and_headers(values):
    rows = [["a"], ["a", "b", "c"], []]
    assert values(lambda c: text.pad_row(c, F.lit(2)), rows, "array<string>") == [
        ["a", ""], ["a", "b", "c"], ["", ""],
    ]
    assert values(text.default_headers, [0, 2], "int") == [[], ["Col 1", "Col 2"]]
    assert values(lambda c: text.default_headers(c, "frame"), [2], "int") == [["col_0", "col_1"]]
    assert values(text.last_or_blank, [["a", "b"], [], None], "array<string>") == ["b", "", ""]


def test_names(values):
    stems = ["in/a.b.pdf", "", None, "x", "/d/.pdf", "a/b/"]
    assert values(text.file_stem, stems) == ["a.b", "pdf", "pdf", "x", ".pdf", "b"]
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    named = values(lambda c: text.output_name(c, F.lit("all"), F.lit("md"), at), ["r"])
    assert named == ["r_all_20240506_070809.md"]


SEGMENTS = st.sampled_from(["a", "b.pdf", "..", ".", "", "x y", "c;p", "..a", "é"])
PATHS = st.lists(SEGMENTS, max_size=5).map("/".join)
TAILS = st.sampled_from(["", "?q=1", "?", "#f", "#", "?q=a/../b#f?x"])
ORIGINS = st.sampled_from(["http://h.example", "https://h.example:81", "HTTP://H.example", "ftp://f", ""])
LEADS = st.sampled_from(["", "", "", " ", "\t\x00"])
UNTIDY = st.builds(
    lambda lead, o, p, t: lead + (o + "/" + p).replace("a", "a\n") + t, LEADS, ORIGINS, PATHS, TAILS
)
BASES = st.builds(lambda o, p, t: o + ("/" + p if o else p) + t, ORIGINS, PATHS, TAILS)
REFS = st.builds(
    lambda o, p, t: o + p + t,
    st.sampled_from(["", "", "", "/", "//g.example/", "http://g.example/", "https:", "mailto:", "?", "#"]),
    PATHS,
    TAILS,
)


def joined(base, ref):
    return urljoin(base, ref) if base else ref


@SPARK
@given(st.lists(st.tuples(BASES, REFS), min_size=200, max_size=250))
def test_resolve_url(spark, pairs):
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, base string, ref string")
    out = df.select("n", urls.resolve_url(F.col("base"), F.col("ref")).alias("url")).orderBy("n").collect()
    wrong = [
        (p, r.url, joined(*p)) for p, r in zip(pairs, out) if r.url != joined(*p)
    ]
    assert wrong == []


@SPARK
@given(st.lists(st.one_of(BASES, UNTIDY), min_size=100, max_size=120))
def test_url_parts(values, inputs):
    for part, field in (("scheme", "scheme"), ("host", "netloc"), ("query", "query"), ("fragment", "fragment")):
        assert values(lambda c: urls.url_part(c, part), inputs) == [getattr(urlparse(u), field) for u in inputs]
    with pytest.raises(ValueError, match="Unknown URL part"):
        urls.url_part(F.col("v"), "user")


@SPARK
@given(st.lists(st.one_of(BASES, UNTIDY), min_size=100, max_size=120))
def test_is_pdf_url(values, inputs):
    plain = [urlparse(u).path.lower().endswith(".pdf") for u in inputs]
    assert values(urls.is_pdf_url, inputs) == plain


def test_valid_urls_are_split_from_rejects(spark):
    rows = ["https://a/x y", " http://a", "ftp://a", "https:///x", None, "a"]
    df = spark.createDataFrame([(u,) for u in rows], "url string")
    good, bad = urls.split_valid_urls(df)
    assert sorted(r.url for r in good.collect()) == [" http://a", "https://a/x y"]
    assert {r.url: r.reason for r in bad.collect()} == {
        "ftp://a": "scheme is not http or https",
        "https:///x": "no host",
        None: "missing",
        "a": "scheme is not http or https",
    }


def test_keep_href(values):
    hrefs = ["javascript:x", "JavaScript:x", "mailto:a", "#x", ""]
    assert values(urls.keep_href, hrefs) == [False, True, True, True, True]


def test_file_name(values):
    given_urls = ["https://a/b/c.pdf?x", "https://a/b/c.PDF/", "https://a/b/c?x", "?x"]
    assert values(urls.url_filename, given_urls) == ["c.pdf", "c.PDF", "c.pdf", "downloaded.pdf"]


GOLDEN = [
    ("all", 5, [0, 1, 2, 3, 4]),
    ("", 5, [0, 1, 2, 3, 4]),
    (None, 2, [0, 1]),
    ("3", 5, [2]),
    ("2-4", 5, [1, 2, 3]),
    ("1,3,5", 5, [0, 2, 4]),
    ("1,3-5", 6, [0, 2, 3, 4]),
    ("3-", 5, [2, 3, 4]),
    ("-3", 5, [0, 1, 2]),
    ("1,10,20", 5, [0]),
    ("1,1,2,2", 5, [0, 1]),
    ("1-5", 5, [0, 1, 2, 3, 4]),
    ("3,1", 5, [2, 0]),
    ("5-2", 9, []),
    ("0", 5, []),
    ("  ", 5, []),
    ("all", 0, []),
    ("1-99999999999999", 3, [0, 1, 2]),
    ("99999999999999-", 3, []),
    (" 2 - 3 , 1 ", 5, [1, 2, 0]),
    ("x", 5, None),
    ("1,-", 5, None),
    ("a-b", 5, None),
]


def expanded(spark, cases):
    df = spark.createDataFrame([(n, s, t) for n, (s, t) in enumerate(cases)], "n int, spec string, total int")
    rows = df.select("n", pageranges.page_range(F.col("spec"), F.col("total")).alias("p")).orderBy("n").collect()
    return [r.p for r in rows]


def test_page_range_golden(spark):
    assert expanded(spark, [(s, t) for s, t, _ in GOLDEN]) == [want for *_, want in GOLDEN]


PARTS = st.one_of(
    st.integers(0, 12).map(str),
    st.tuples(st.integers(0, 12), st.integers(0, 12)).map(lambda p: f"{p[0]}-{p[1]}"),
    st.integers(0, 12).map(lambda n: f"{n}-"),
    st.integers(0, 12).map(lambda n: f"-{n}"),
    st.just(" "),
)
SPECS = st.lists(PARTS, min_size=1, max_size=5).map(",".join)


def plain_range(spec, total):
    pages = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, dash, high = part.partition("-")
        first = int(low or 1)
        last = (int(high) if high else total) if dash else first
        pages += [p - 1 for p in range(max(first, 1), min(last, total) + 1)]
    return list(dict.fromkeys(pages))


@SPARK
@given(st.lists(st.tuples(SPECS, st.integers(0, 8)), min_size=100, max_size=150))
def test_page_range(spark, cases):
    assert expanded(spark, cases) == [plain_range(s, t) if s else list(range(t)) for s, t in cases]


def test_literal_specs_are_checked_at_once():
    for good in (None, "", "all", " 1 - 3, 5-,-2 "):
        pageranges.check_spec(good)
    for bad in ("x", "-", "1,a-b", "1--2"):
        with pytest.raises(ValueError, match="Bad page range"):
            pageranges.check_spec(bad)


def test_links_left_unresolved_are_never_pdf_links(spark):
    ends = ("", ".pdf", ".PDF", ".pd\tf", ".p\ndf?", ".pdf#", ".pdf?#", "?", "#", "?#", "#x.pdf", "?x.pdf", ";.pdf", ".pdf;x", "x.html", "/..", ".pdf/.", "/../x.pdf")
    hrefs = [a + b for a in ("", "/", "//", "https:", "HTTPS://", "ht\ttps:", "mailto:", "..", ".", "a", "a/b", "//h", "http://h/a", "\x01", "\x01https:") for b in ends]
    bases = [None, "", "https://h/x/y.pdf", "https://h/x?q=y.pdf", "https://h.pdf", "http:z.pdf", "mailto:z.pdf", "x/y.pdf"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    base, href = F.col("base"), F.col("href")
    is_pdf = urls.is_pdf_href(urls.resolve_url(base, href))
    resolved = rows.select("base", "href", is_pdf.alias("is_pdf"), urls.may_be_pdf_href(href).alias("may"))
    found = resolved.collect()
    assert not [row for row in found if row.is_pdf and not row.may]
    assert any(row.is_pdf and not row.href.lower().endswith(".pdf") for row in found)
    assert sum(not row.may for row in found) > len(found) / 4
