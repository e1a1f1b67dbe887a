"""The node table: tree repair, entities, raw text, limits."""

from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from pagesift.sources.html import _add_page, _NodeColumns, page_nodes


def nodes(html, tags=None, attrs=None, keep_noise=False):
    out = _NodeColumns()
    _add_page(out, html, tags and frozenset(tags), attrs and frozenset(attrs), keep_noise)
    return out


def outline(html, **limits):
    """``tag(children)`` with text in quotes."""
    out = nodes(html, **limits)

    def show(i):
        if out.tag[i] == "#text":
            return repr(out.text[i])
        kids = [show(j) for j in range(i + 1, out.last[i] + 1) if out.parent[j] == i]
        return out.tag[i] + (f"({' '.join(kids)})" if kids else "")

    return " ".join(show(i) for i in range(len(out.tag)) if out.parent[i] == -1)


def test_paragraph_start_ends_paragraph_even_through_inline_tags():
    assert outline("<p><b>a<br><p>b") == "p(b('a' br)) p('b')"


def test_block_start_ends_paragraph():
    assert outline("<p>a<div>b</div>c") == "p('a') div('b') 'c'"


def test_list_items_end_their_own_kind_within_the_nearest_list():
    assert outline("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "ul(li('a') li('b' ul(li('c'))) li('d'))"


def test_rows_and_cells_end_their_own_kind_within_the_nearest_table():
    html = "<table><tr><td>a<td>b<table><tr><td>c</table><tr><th>d</table>"
    assert outline(html) == "table(tr(td('a') td('b' table(tr(td('c'))))) tr(th('d')))"


def test_options_and_definitions_end_their_own_kind():
    assert outline("<select><option>a<option>b</select>") == "select(option('a') option('b'))"
    assert outline("<dl><dt>a<dd>b<dt>c</dl>") == "dl(dt('a') dd('b') dt('c'))"


def test_void_tags_never_nest_and_stray_end_tags_are_ignored():
    assert outline("a<br>b</br></i><img>c") == "'a' br 'b' img 'c'"


def test_end_tag_does_not_leave_its_cell():
    assert outline("<div><table><tr><td>a</div>b</table>c") == "div(table(tr(td('ab'))) 'c')"


def test_open_tags_close_at_the_end_and_a_cut_tag_is_dropped():
    assert outline("<div><b>a") == "div(b('a'))"
    assert outline("<p>a<b") == "p('a')"
    assert outline("<p>a</p") == "p('a')"
    assert outline("a < b <5") == "'a < b <5'"


def test_script_and_style_are_raw_and_kept_apart_from_text():
    out = nodes('<p>a<script>var t="</p>";</SCRIPT>b', keep_noise=True)
    assert list(zip(out.tag, out.text)) == [
        ("p", None), ("#text", "a"), ("script", None), ("#script", 'var t="</p>";'), ("#text", "b"),
    ]


def test_comments_doctype_and_instructions_vanish():
    assert outline("<!DOCTYPE html><!-- <p> -->a<?x y?>b<!-->c") == "'a' 'b' 'c'"


def test_noise_is_dropped_or_marked():
    html = "<p>a<noscript><i>b</i></noscript><style>c</style><iframe>d</iframe>e"
    assert outline(html) == "p('a' 'e')"
    marked = nodes(html, keep_noise=True)
    assert [t for t, noise in zip(marked.tag, marked.noise) if noise] == [
        "noscript", "i", "#text", "style", "#style", "iframe", "#text",
    ]


def test_dropped_noise_does_not_count_as_a_child():
    out = nodes("<ul><style>x</style><li>a<li>b</ul>")
    assert [(t, p) for t, p in zip(out.tag, out.pos) if t == "li"] == [("li", 1), ("li", 2)]


def test_attributes():
    out = nodes("""<a HREF = "x&amp;y&copy=2" title=it's href=z data-x disabled q='a>b'>""")
    assert dict(zip(out.attr_keys, out.attr_values)) == {
        "href": "x&y&copy=2", "title": "it's", "data-x": "", "disabled": "", "q": "a>b",
    }


def test_entities_in_text():
    assert outline("&lt;p&gt; &amp;amp; &eacute; &#233; &nope;") == "'<p> &amp; é é &nope;'"


def test_limits_keep_positions_and_regions():
    out = nodes("<ul><li>a<b>x</b><li><a href=u rel=r>c</a></ul>t", tags={"li"}, attrs={"href"})
    assert list(zip(out.tag, out.parent, out.last, out.pos)) == [
        ("li", -1, 2, 1), ("#text", 0, 1, None), ("#text", 0, 2, None), ("li", -1, 4, 2), ("#text", 3, 4, None),
    ]
    assert out.attr_keys == []


def test_next_sibling():
    out = nodes("<i>a</i>t<b>c</b>")
    assert dict(zip(out.tag, out.next))["i"] == out.tag.index("b")


WORDS = st.text(alphabet="abé \n&<>\"'", max_size=6)


@st.composite
def fragments(draw, depth=3):
    """Well-formed markup out of tags that need no repair."""
    parts = []
    for _ in range(draw(st.integers(0, 3))):
        if depth and draw(st.booleans()):
            tag = draw(st.sampled_from(["i", "span", "b", "em"]))
            quoted = draw(WORDS).replace("&", "&amp;").replace('"', "&quot;")
            parts.append(f'<{tag} title="{quoted}">{draw(fragments(depth - 1))}</{tag}>')
        else:
            parts.append(draw(WORDS).replace("&", "&amp;").replace("<", "&lt;"))
    return "".join(parts)


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tags, self.titles, self.text = [], [], []

    def handle_starttag(self, tag, attrs):
        self.tags.append(tag)
        self.titles += [v for _, v in attrs]

    def handle_data(self, data):
        self.text.append(data)


@settings(max_examples=300, deadline=None)
@given(fragments())
def test_agrees_with_the_standard_parser(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    out = nodes(html)
    assert [t for t in out.tag if t != "#text"] == reader.tags
    assert out.attr_values == reader.titles
    assert "".join(t for t in out.text if t) == "".join(reader.text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab=\"' !-&;p\n", max_size=60))
def test_any_input_gives_a_sound_tree(html):
    out = nodes(html)
    for i, (last, parent) in enumerate(zip(out.last, out.parent)):
        assert i <= last < len(out.tag)
        assert parent < i
        if parent >= 0:
            assert last <= out.last[parent]


def test_large_batches_are_cut(spark):
    html = "<p>x</p>" * 30_000
    df = spark.createDataFrame([(n, "u", html) for n in range(6)], "page_id bigint, url string, html string")
    sizes = page_nodes(df.coalesce(1)).selectExpr("page_id", "size(nodes) as n").collect()
    assert sorted((r.page_id, r.n) for r in sizes) == [(n, 60_000) for n in range(6)]


def test_deep_and_unmatched_tags_take_linear_time(spark):
    import time

    from pagesift.sources.html import page_nodes

    def seconds(html):
        df = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
        start = time.perf_counter()
        page_nodes(df).selectExpr("size(nodes)").collect()
        return time.perf_counter() - start

    for shape in (lambda n: "<b><div>x" * n, lambda n: "<b>" * n + "</i>" * n):
        seconds(shape(100))
        assert seconds(shape(40_000)) < 3 * seconds(shape(20_000)) + 1


def test_links_come_without_texts_when_only_their_targets_are_read(spark, pages):
    html = "<ul><li>a<a href=x>b</a><li><a href=y>c<p>d</a></ul>"
    parsed = page_nodes(pages(("u", html)), tags=("a",), attrs=("href",), texts=False).first()
    assert [(n.id, n.last, n.tag, n.attrs["href"]) for n in parsed.nodes] == [(0, 0, "a", "x"), (1, 1, "a", "y")]
