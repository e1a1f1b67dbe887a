"""Page extraction: modes, traps, selectors, videos, rendering."""

import json

import pytest
from pyspark.sql import functions as F

from pagesift.operators import extract as X
from pagesift.operators import render
from pagesift.operators.css import parse_selector
from pagesift.operators.video import video_metadata

URL = "https://t.example.com/a/b?x=1"
RICH = """<!DOCTYPE html><html><head><title> A  page </title>
<meta name="description" content=" What it is "><meta property="og:title" content="OG"><meta name="">
<style>.x { color: red }</style></head><body>
<h1>Main <i>head</i></h1><h2> </h2>
<p>One  two<br>three</p><p></p>
<ul><li><p>Inner</p></li><li>Plain</li></ul>
<a href=" c.html " title="T" rel="nofollow  noopener">Rel</a>
<a href="">self</a><a href="javascript:x()">js</a><a href="mailto:a@b.c">mail</a><a name="n">no</a>
<img src=" /i.jpg " alt="A" width="800"><img src=""><img>
<script>alert("noise")</script><noscript><p>hidden</p></noscript>
<a href="/d.pdf">d</a><a href="/d.pdf">d</a><a href="/e.PDF?v=1">e</a><a href="/f.pdf#p">f</a>
</body></html>"""


def items(df, mode, **options):
    return [r.asDict(recursive=True) for r in X.extract(df, mode, **options).first()["items"]]


def test_unknown_mode_and_missing_selector_raise_before_anything_runs(pages):
    df = pages((URL, RICH))
    with pytest.raises(ValueError, match="Unknown mode"):
        X.extract(df, "nonsense")
    with pytest.raises(ValueError, match="CSS selector required"):
        X.extract(df, "custom")


def test_links(pages):
    found = items(pages((URL, RICH)), "links")
    assert [(x["text"], x["href"]) for x in found] == [
        ("Rel", "https://t.example.com/a/c.html"),
        ("self", URL),
        ("mail", "mailto:a@b.c"),
        ("d", "https://t.example.com/d.pdf"),
        ("d", "https://t.example.com/d.pdf"),
        ("e", "https://t.example.com/e.PDF?v=1"),
        ("f", "https://t.example.com/f.pdf#p"),
    ]
    assert (found[0]["title"], found[0]["rel"]) == ("T", "nofollow noopener")


def test_link_targets_are_the_hrefs_of_links(pages):
    df = pages((URL, RICH))
    assert X.link_targets(df).first().hrefs == [x["href"] for x in items(df, "links")]


def test_links_without_base_stay_raw(pages):
    assert items(pages(("", RICH)), "links")[0]["href"] == "c.html"


def test_text_blocks_repeat_nested_content_and_follow_the_clean_flag(pages):
    df = pages((URL, RICH))
    assert [(x["tag"], x["content"]) for x in items(df, "text")] == [
        ("h1", "Main head"), ("p", "One twothree"), ("li", "Inner"), ("p", "Inner"), ("li", "Plain"),
    ]
    raw = items(df, "text", clean=False)
    assert ("h2", " ") in [(x["tag"], x["content"]) for x in raw]
    assert ("p", "One  twothree") in [(x["tag"], x["content"]) for x in raw]


def test_images(pages):
    assert items(pages((URL, RICH)), "images") == [
        {"src": "https://t.example.com/i.jpg", "alt": "A", "title": "", "width": "800", "height": ""}
    ]


def test_meta(pages):
    assert [(m["name"], m["property"], m["content"]) for m in items(pages((URL, RICH)), "meta")] == [
        ("description", "", " What it is "), ("", "og:title", "OG"),
    ]


def test_tables(pages):
    html = """<table><tr><td> </td></tr></table>
    <table><caption> C  1 </caption><thead><tr><td>k<td>v</thead><tr><th>a<td>
    <table><tr><td>in</table></table>"""
    first, second = items(pages((URL, html)), "tables")
    assert (first["table_index"], first["caption"], first["has_header"]) == (1, "C 1", True)
    assert first["rows"] == [["k", "v"], ["a", "in", "in"], ["in"]]
    assert (second["table_index"], second["has_header"], second["rows"]) == (2, False, [["in"]])
    raw = items(pages((URL, html)), "tables", clean=False)
    assert raw[0]["rows"] == [[" "]] and raw[1]["caption"] == "C 1"


def test_title_needs_a_single_string(pages):
    titles = ["<title> a </title>", "<title>a<b>c</b></title>", "<title></title>", "", "<title>a</title><title>b"]
    df = pages(*[(URL, t) for t in titles])
    found = [r.title for r in X.page_titles(df).orderBy("page_id").collect()]
    assert found == ["a", "", "", "", "a"]


def test_page_record(pages):
    df = pages((URL, RICH))
    row = X.page_record(df, clean=False).first()
    assert row.title == "A  page"
    assert row.headings == ["Main head"]
    assert row.paragraphs == ["One twothree", "Inner"]  # cleaned even here
    assert row.meta is None
    assert len(X.page_record(df, include_meta=True).first().meta) == 2


def test_digest(pages):
    row = X.page_digest(pages((URL, RICH))).first()
    assert (row.url, row.title, row.description) == (URL, "A  page", "What it is")
    # Strings are joined by spaces, and noise is not removed here.
    assert row.main_text.split("\n") == ["Main head", "One two three", "Inner", "Inner", "Plain", "hidden"]
    assert row.pdf_links == ["https://t.example.com/d.pdf", "https://t.example.com/e.PDF?v=1"]


def test_digest_budget_keeps_the_chunk_that_exceeds_it(pages):
    html = "".join(f"<p>{'x' * n}</p>" for n in (1999, 1, 5, 7))
    text = X.page_digest(pages((URL, html))).first().main_text
    assert [len(t) for t in text.split("\n")] == [1999, 1, 5]
    assert X.budgeted_text(pages((URL, html)), budget=1998).count() == 1


CSS = """<html><body><div id=top class="box  wide"><h1>t</h1><p class=a>1</p><p>2</p><span>s</span><p>3</p></div>
<ul><li><a href="/x.pdf">x</a></li><li><a href="/y" data-k="one two">y</a></li><li>z</li></ul>
<script>var a = 1 < 2</script></body></html>"""


@pytest.mark.parametrize(
    "selector, expected",
    [
        ("p", ["1", "2", "3"]),
        ("h1, p", ["t", "1", "2", "3"]),
        ("p, .a, p.a", ["1", "2", "3"]),
        ("#top > p", ["1", "2", "3"]),
        ("body p", ["1", "2", "3"]),
        ("html > p", []),
        ("h1 + p", ["1"]),
        ("span ~ p", ["3"]),
        ("h1 ~ *", ["1", "2", "s", "3"]),
        (".box.wide h1", ["t"]),
        ("div.wid", []),
        ("a[href]", ["x", "y"]),
        ('a[href="/y"]', ["y"]),
        ("a[href^='/x']", ["x"]),
        ('a[href$=".pdf"]', ["x"]),
        ('a[href*="x.p"]', ["x"]),
        ("a[data-k~=two]", ["y"]),
        ('a[href^=""]', []),
        ("li:first-child", ["x"]),
        ("li:last-child", ["z"]),
        ("li:nth-child(2)", ["y"]),
        ("li:nth-child(odd)", ["x", "z"]),
        ("li:nth-child(-n+2)", ["x", "y"]),
        ("p:not(.a)", ["2", "3"]),
        ("LI A:not([href$='.pdf'])", ["y"]),
        ("script", ["var a = 1 < 2"]),
        ("div *:nth-child(3n)", ["2"]),
    ],
)
def test_selectors(pages, selector, expected):
    hits = items(pages((URL, CSS)), "custom", selector=selector)
    assert [h["content"] for h in hits] == expected
    assert [h["index"] for h in hits] == list(range(len(hits)))


@pytest.mark.parametrize("selector", ["", "p::before", "p:hover", "p >", "[a=", ":not(p q)", "p {", ",p"])
def test_unsupported_selectors_raise(selector):
    with pytest.raises(ValueError):
        parse_selector(selector)


def test_selected_markup_is_written_anew(pages):
    html = "<div title='a\"b' id=\"x&amp;y\">1 &lt; 2<br><i></i><b>t</b></div><p>" + "é" * 600 + "</p>"
    one, long = items(pages((URL, html)), "custom", selector="div, p")
    assert one["html"] == "<div title='a\"b' id=\"x&amp;y\">1 &lt; 2<br/><i></i><b>t</b></div>"
    assert long["html"] == "<p>" + "é" * 497


def watch(blob, end="</script>", og=""):
    return f'<meta property="og:title" content="{og}"><script>var ytInitialPlayerResponse = {blob};{end}<h1>x</h1>'


def test_video(pages):
    full = json.dumps(
        {
            "videoDetails": {
                "videoId": "v",
                "title": "T",
                "author": "C",
                "shortDescription": "é" * 5000,
                "lengthSeconds": "61",
                "viewCount": 7,
                "isLiveContent": True,
                "thumbnail": {"thumbnails": [{"url": "s"}, {"url": "l"}]},
            },
            "microformat": {"playerMicroformatRenderer": {"publishDate": "2024", "category": "Music"}},
        }
    )
    watch_url = "https://www.youtube.com/watch?v=1"
    df = pages(
        (watch_url, watch(full)),
        (watch_url, watch("{}", og=" Og ")),
        (watch_url, watch('{"videoDetails":{"lengthSeconds":"x","viewCount":""}}')),
        (watch_url, watch('{"a":"};"}')),
        (watch_url, watch('{"a":"};"}', end="go();</script>")),  # cut inside the string
        (watch_url, "<h1>x</h1>"),
        ("https://other.example.com/watch?v=1", watch(full)),
    )
    rows = {r.page_id: r for r in video_metadata(df).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    first = rows[0]
    assert (first.platform, first.video_id, first.title, first.channel) == ("youtube", "v", "T", "C")
    assert (first.duration_seconds, first.view_count, first.is_live) == (61, 7, True)
    assert (first.publish_date, first.category, first.thumbnail) == ("2024", "Music", "l")
    assert len(first.short_description) == 4000
    assert (rows[1].title, rows[1].duration_seconds, rows[1].thumbnail) == ("Og", 0, "")
    assert (rows[2].duration_seconds, rows[2].view_count) == (None, 0)
    both = X.extract(df, "essential").orderBy("page_id").collect()
    assert [r.video is not None for r in both] == [True] * 4 + [False] * 3
    assert [r.digest is not None for r in both] == [False] * 4 + [True] * 3


@pytest.mark.parametrize("mode", [m for m in X.MODES])
@pytest.mark.parametrize("fmt", ["json", "csv", "txt", "md"])
def test_every_mode_renders_in_every_format(pages, mode, fmt):
    df = pages((URL, RICH + "<table><tr><td>1</table>"), (URL, ""))
    extracted = X.extract(df, mode, selector="p", include_meta=True)
    rows = render.render_pages(extracted, mode, fmt, "now").collect()
    if fmt == "csv":
        assert rows
        return
    bodies = [r.body for r in sorted(rows, key=lambda r: r.page_id)]
    assert len(bodies) == 2 and None not in bodies
    if fmt == "json":
        assert json.loads(bodies[0])["metadata"] == {"url": URL, "mode": mode, "scraped_at": "now"}
        assert "data" in json.loads(bodies[1])
    else:
        assert bodies[0].startswith("# Scraped")


def test_page_markdown_of_an_empty_page(pages):
    df = pages((URL, ""))
    body = render.page_md(X.extract(df, "links"), "links", "now").first().body
    assert body.endswith("| Scraped at | `now` |\n\n_No items found._")
    body = render.page_md(X.extract(df, "all"), "all", "now").first().body
    assert "## Headings\n_(empty)_\n\n" in body and "## Meta" not in body


def test_markdown_cells_are_escaped_then_cut(pages):
    html = f'<a href="/x">{"|" * 100}</a>'
    body = render.page_md(X.extract(pages((URL, html)), "links"), "links", "now").first().body
    assert body.split("\n")[-1].startswith("| " + "\\|" * 60 + " | https")


def test_unknown_format_raises(pages):
    with pytest.raises(ValueError, match="Unknown format"):
        render.render_pages(X.extract(pages((URL, RICH)), "links"), "links", "xlsx", "now")


def test_flattened_columns_are_in_first_seen_order(pages):
    rows = render.flatten_sections(X.page_record(pages((URL, RICH)), include_meta=True))
    assert rows.columns[:6] == ["page_id", "section", "pos", "value", "text", "href"]
    counts = {r.section: r["count"] for r in rows.groupBy("section").count().collect()}
    assert counts == {"title": 1, "headings": 1, "paragraphs": 2, "links": 7, "images": 1, "meta": 2}
    assert rows.filter(F.col("section") == "links").filter("value is not null").count() == 0


@pytest.mark.parametrize(
    ("selector", "expected"),
    [
        ("li ~ li", ["y", "2", "3"]),
        ("li + li", ["y", "2"]),
        ("#a ~ .b", ["2"]),
        ("ul li li", ["x", "y"]),
        ("ul > li > ul > li", ["x", "y"]),
        ("li ~ p, div p", ["q", "z"]),
        ("div div", ["z"]),
        ("p ~ li", ["3"]),
        ("body ~ p", []),
        ("li:not(:first-child):not(.b)", ["y", "3"]),
    ],
)
def test_relations_between_selected_elements(pages, selector, expected):
    html = (
        "<ul><li id=a>1<ul><li>x</li><li>y</li></ul></li><li class=b>2</li><p>q</p><li>3</li></ul>"
        "<div><div><p>z</p></div></div>"
    )
    hits = X.select(pages(("http://a/", html)), selector).orderBy("index").collect()
    assert [h.content for h in hits] == expected


def test_markup_of_nested_and_cut_elements(pages):
    html = "<div><b>1<i>2</i></b><br><p>" + "x" * 900 + "</p></div>"
    hits = {h.tag: h.html for h in X.select(pages(("http://a/", html)), "div, b, i").collect()}
    assert hits["b"] == "<b>1<i>2</i></b>"
    assert hits["i"] == "<i>2</i>"
    assert hits["div"] == ("<div><b>1<i>2</i></b><br/><p>" + "x" * 900)[:500]


def test_content_and_markup_by_offset(pages):
    html = (
        "<div title='a\"b'><p title='\"&#39;'>é&lt;&amp;</p><script>if (a<b) {}</script><img src=x><style>p{}</style>"
        "<!-- c -->\U0001f600<table><tr><td>1<td>2</table></div>"
    )
    hits = {h.tag: (h.content, h.html) for h in X.select(pages(("http://a/", html)), "div, p, script, img, tr", clean=False).collect()}
    assert hits["p"] == ("é<&", "<p title=\"&quot;'\">é&lt;&amp;</p>")
    assert hits["script"] == ("if (a<b) {}", "<script>if (a<b) {}</script>")
    assert hits["img"] == ("", '<img src="x"/>')
    assert hits["tr"] == ("12", "<tr><td>1</td><td>2</td></tr>")
    assert hits["div"][0] == "é<&\U0001f60012" and hits["div"][1].startswith("<div title='a\"b'><p title")
    long = "<b>" + "\U0001f600" * 600 + "</b>"
    (hit,) = X.select(pages(("http://a/", long)), "b").collect()
    assert hit.html == "<b>" + "\U0001f600" * 497 and hit.content == "\U0001f600" * 600


def test_nested_hits_take_the_time_of_siblings(spark):
    import time

    def seconds(html, n):
        df = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
        start = time.perf_counter()
        assert X.select(df, "div").filter("length(html) > 5 and content = 'x'").count() == n
        return time.perf_counter() - start

    def nested(n):
        return "<div>" * n + "x" + "</div>" * n

    seconds(nested(100), 100)
    siblings = seconds("<div>x</div>" * 40_000, 40_000)
    once, twice = seconds(nested(20_000), 20_000), seconds(nested(40_000), 40_000)
    assert twice < 3 * once + 1 and twice < 3 * siblings + 2
