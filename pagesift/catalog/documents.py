"""Queries on paged documents and their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.catalog import derived
from pagesift.catalog.pages import AT, flat
from pagesift.catalog.registry import query, table
from pagesift.catalog.sql import DOC_PAGES, NL, normalise, strip
from pagesift.functions.text import normalise_page
from pagesift.operators import grids, paged, reports, summaries
from pagesift.plans import answers
from pagesift.plans.documents import process_docs
from pagesift.plans.scratch import scratch_path
from pagesift.schema import DEFAULT_PROMPT
from pagesift.sources import pdf

PROMPT_HEAD = f"'{DEFAULT_PROMPT}' || {NL} || {NL} || 'Document text:' || {NL}"

FULL_TEXT = f"""{DOC_PAGES}, full_texts AS (
  SELECT doc_id, coalesce(string_agg('[Page ' || page_no || ']' || {NL} || norm, {NL} || {NL} ORDER BY page_no)
                          FILTER (norm <> ''), '') AS full_text
  FROM doc_pages GROUP BY doc_id)"""

# The two tables of every document of ``derived.paged_documents``. The second is on
# page 2, so documents of one page have only the first.
DOC_TABLES = f"""firsts AS (
  SELECT doc_id, lang, source, n_chars, string_split(text, {NL})[1] AS line,
         len(string_split(text, {NL})) AS n_pages FROM documents),
doc_tables AS (
  SELECT doc_id, 1 AS page_no, 0 AS table_index, ['lang', 'source | place', 'chars'] AS headers,
         [[lang, source, n_chars::VARCHAR], ['', 'x y']] AS rows, 2 AS row_count, 3 AS col_count, n_pages FROM firsts
  UNION ALL
  SELECT doc_id, 2, 0, CASE WHEN length({strip("line")}) < 60 THEN [{strip("line")}, lang] END,
         CASE WHEN length({strip("line")}) < 60 THEN [[source, ',']] ELSE [[{strip("line")}, lang], [source, ',']] END,
         CASE WHEN length({strip("line")}) < 60 THEN 1 ELSE 2 END, 2, n_pages FROM firsts)"""

ORDER_TABLES = """order_tables AS (
  SELECT o_orderkey AS doc_id, 3 AS page_no, 1 AS table_index, o_orderpriority <> '1-URGENT' AS headed,
         [['order', 'status|x', CASE WHEN o_orderpriority = '1-URGENT' THEN repeat('priority', 8) ELSE 'priority' END],
          [o_orderkey::VARCHAR, o_orderstatus, o_orderpriority || ' x'], ['', ''], [o_custkey::VARCHAR, 'a, "b"']]
         AS grid FROM orders), shaped AS (
  SELECT *, CASE WHEN headed THEN grid[1] END AS headers, CASE WHEN headed THEN grid[2:] ELSE grid END AS rows
  FROM order_tables)"""


@query("doc_pages", f"WITH {DOC_PAGES} SELECT doc_id, page_no, text FROM doc_pages")
def doc_pages(spark, folder):
    return paged.doc_pages(derived.paged_documents(spark, folder))


@query(
    "doc_info",
    f"""SELECT doc_id, len(string_split(text, {NL}))::INTEGER AS total_pages, source AS title, lang AS author,
    '' AS subject, '' AS creator, '' AS created, '' AS modified FROM documents""",
)
def doc_info(spark, folder):
    return pdf.doc_info(derived.paged_documents(spark, folder))


@query(
    "doc_char_totals",
    f"""WITH {DOC_PAGES} SELECT doc_id, count(*) AS n_pages, sum(length(norm))::BIGINT AS total_chars
    FROM doc_pages GROUP BY doc_id""",
)
def doc_char_totals(spark, folder):
    return paged.doc_totals(derived.paged_documents(spark, folder))


@query(
    "doc_char_totals_page_rows",
    """SELECT conv_id AS doc_id, count(*) AS n_pages, sum(length(text))::BIGINT AS total_chars
    FROM conversations GROUP BY conv_id""",
)
def doc_char_totals_page_rows(spark, folder):
    return paged.doc_char_totals(derived.page_rows(spark, folder))


# Expressions and what they mean: parts in order, from and to, to the last page where null.
SPECS = {
    "all": [(1, None)],
    "": [(1, None)],
    " ALL ": [(1, None)],
    "3": [(3, 3)],
    "2-4": [(2, 4)],
    "1,3,5": [(1, 1), (3, 3), (5, 5)],
    "3-5,1": [(3, 5), (1, 1)],
    "3-": [(3, None)],
    "-3": [(1, 3)],
    "1,10,20": [(1, 1), (10, 10), (20, 20)],
    "1,1,2,2": [(1, 1), (1, 1), (2, 2), (2, 2)],
    "2-999999999999": [(2, None)],
    "5-2": [],
    "0": [],
    " , ": [],
}
SPEC_PARTS = "(VALUES {}) AS parts(spec, part, low, high)".format(
    ", ".join(
        f"('{spec}', {n}, {low}, {'NULL::BIGINT' if high is None else high})"
        for spec, parts in SPECS.items()
        for n, (low, high) in enumerate(parts)
    )
)


@query(
    "page_range",
    f"""WITH sizes AS (SELECT doc_id, len(string_split(text, {NL})) AS total FROM documents), named AS (
    SELECT doc_id, spec, part, unnest(range(low, least(coalesce(high, total), total) + 1)) AS page
    FROM sizes, {SPEC_PARTS}), firsts AS (
    SELECT doc_id, spec, page, min(part * 1000000 + page) AS place FROM named GROUP BY ALL)
    SELECT doc_id, spec, (page - 1)::INTEGER AS page_index,
           (row_number() OVER (PARTITION BY doc_id, spec ORDER BY place) - 1)::INTEGER AS pos FROM firsts""",
)
def page_ranges(spark, folder):
    specs = F.array(*[F.lit(s) for s in SPECS])
    docs = table(spark, folder, "documents").select(
        "doc_id", F.size(F.split("text", "\n")).alias("total"), F.explode(specs).alias("spec")
    )
    expanded = paged.expand_ranges(docs)
    named = expanded.select("doc_id", "spec", F.posexplode_outer("pages").alias("pos", "page_index"))
    return named.filter("pos is not null")


@query(
    "page_range_errors",
    """SELECT doc_id, spec, 'bad page range: ' || bad AS reason FROM documents,
    (VALUES ('x', 'x'), ('1,-', '-'), ('1, a-b ,y', 'a-b')) AS s(spec, bad)""",
)
def page_range_errors(spark, folder):
    specs = F.array(*[F.lit(s) for s in ("x", "1,-", "1, a-b ,y", "2-3")])
    docs = table(spark, folder, "documents").select(
        "doc_id", F.lit(9).alias("total"), F.explode(specs).alias("spec")
    )
    return paged.expand_ranges(docs).filter("pages is null").select("doc_id", "spec", "reason")


@query(
    "selected_pages",
    f"""WITH {DOC_PAGES} SELECT doc_id, page_no, norm AS text FROM doc_pages
    WHERE page_no IN (1, 3, 4) OR page_no >= 8""",
)
def selected_pages(spark, folder):
    return paged.select_pages(derived.paged_documents(spark, folder), "8-,3-4,1")


@query(
    "kept_page_rows",
    """SELECT conv_id AS doc_id, (turn + 1)::INTEGER AS page_no, text FROM conversations
    WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND turn = 1""",
)
def kept_page_rows(spark, folder):
    good = table(spark, folder, "labels").filter("quality = 1")
    wanted = good.select("doc_id", F.lit(2).alias("page_no"))
    return paged.keep_pages(derived.page_rows(spark, folder), wanted)


@query("doc_full_text", f"WITH {FULL_TEXT} SELECT doc_id, full_text FROM full_texts")
def doc_full_text(spark, folder):
    return paged.doc_full_text(derived.paged_documents(spark, folder))


@query(
    "summary_prompts",
    f"""WITH {FULL_TEXT} SELECT doc_id, {PROMPT_HEAD} || substr(full_text, 1, 8000) AS prompt FROM full_texts""",
)
def summary_prompts(spark, folder):
    texts = paged.doc_full_text(derived.paged_documents(spark, folder))
    return texts.select("doc_id", summaries.summary_prompt(F.col("full_text")).alias("prompt"))


@query(
    "summary_prompts_page_rows",
    f"""SELECT conv_id AS doc_id, 'In short:' || {NL} || {NL} || 'Document text:' || {NL} ||
    substr(string_agg('[Page ' || (turn + 1) || ']' || {NL} || text, {NL} || {NL} ORDER BY turn), 1, 8000) AS prompt
    FROM conversations WHERE {strip("text")} <> '' GROUP BY conv_id""",
)
def summary_prompts_page_rows(spark, folder):
    texts = paged.leading_text(derived.page_rows(spark, folder))
    prompt = summaries.summary_prompt(F.col("text"), "In short:")
    return texts.select("doc_id", prompt.alias("prompt"))


@query(
    "doc_text_chunks",
    f"""WITH texts AS (
      SELECT source AS doc_id, string_agg('[Page ' || doc_id || ']' || {NL} || text, {NL} || {NL} ORDER BY doc_id) AS t
      FROM documents WHERE {strip("text")} <> '' GROUP BY source)
    SELECT doc_id, chunk_no, substr(t, chunk_no * 50000 + 1, 50000) AS text
    FROM texts, unnest(range(0, (length(t) + 49999) // 50000)) AS c(chunk_no)""",
)
def doc_text_chunks(spark, folder):
    """A source as one document, its texts as pages: some documents have most of the pages."""
    return paged.text_chunks(derived.source_volumes(spark, folder), size=50_000)


@query(
    "summary_status",
    f"""WITH {FULL_TEXT}, counted AS (
    SELECT doc_id, full_text, len(string_split('Count.' || {NL} || {NL} || 'Document text:' || {NL} ||
                                               substr(full_text, 1, 8000), ' ')) AS words FROM full_texts)
    SELECT doc_id, CASE WHEN full_text = '' THEN '[No text content found to summarize.]'
                        WHEN words < 60 THEN '[Summarization failed: too short]'
                        WHEN words < 1000 THEN words || ' words' ELSE '[too long]' END AS summary,
           full_text <> '' AND words BETWEEN 60 AND 999 AS has_summary FROM counted""",
)
def summary_status(spark, folder):
    def word_count(prompt: str) -> str:
        """Stands in for a language model: refuses some prompts, fails on others."""
        words = len(prompt.split(" "))
        if words < 60:
            raise RuntimeError("too short")
        return f"{words} words" if words < 1000 else "[too long]"

    texts = paged.doc_full_text(derived.paged_documents(spark, folder))
    done = summaries.summarise(texts, word_count, "full_text", "Count.")
    return done.select("doc_id", "summary", summaries.has_summary(F.col("summary")).alias("has_summary"))


@query(
    "summaries_once",
    f"""SELECT doc_id, CASE WHEN {strip("first")} = '' THEN '[No text content found to summarize.]'
        WHEN length(prompt) % 7 = 0 THEN '[Summarization failed: again]' ELSE length(prompt) || ' characters' END AS summary
    FROM (SELECT doc_id, coalesce(string_split(text, {NL})[1], '') AS first,
                 'Count.' || {NL} || {NL} || 'Document text:' || {NL} || substr(first, 1, 8000) AS prompt FROM documents)""",
)
def summaries_once(spark, folder):
    """The first lines of texts, many of them equal, summarised in two runs over one store. The second
    run has another function, of which nothing may show but its failures, where the first failed."""

    def first(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("not now")
        return f"{len(prompt)} characters"

    def second(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise RuntimeError("again")
        return "asked twice"

    store = scratch_path(spark, "answers")
    lines = table(spark, folder, "documents").select(
        "doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("full_text")
    )
    once = answers.summaries_once(lines, first, store, instruction="Count.")
    once.write.format("noop").mode("overwrite").save()
    return answers.summaries_once(lines, second, store, instruction="Count.").select("doc_id", "summary")


@query(
    "process_docs",
    f"""WITH {DOC_PAGES}, {DOC_TABLES}, texts AS (
    SELECT doc_id, count(*)::INTEGER AS n_pages, sum(length(norm))::BIGINT AS chars,
           max(norm) FILTER (page_no = 2) AS page_2 FROM doc_pages WHERE page_no <= 2 GROUP BY doc_id),
    found AS (SELECT doc_id, sum(row_count)::BIGINT AS n_rows FROM doc_tables WHERE page_no <= n_pages GROUP BY doc_id)
    SELECT doc_id, 'https://docs.example.com/' || source || '/' || doc_id || '.pdf' AS source,
           source AS title, t.n_pages, chars, page_2, n_rows,
           '[Summarization needs a summary function; none was given.]' AS summary
    FROM documents JOIN texts t USING (doc_id) JOIN found USING (doc_id)""",
)
def processed(spark, folder):
    done = process_docs(derived.paged_documents(spark, folder), "all", "-2")
    chars = F.aggregate("text_pages", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p["text"]))
    rows = F.aggregate("tables", F.lit(0).cast("bigint"), lambda n, t: n + t["row_count"])
    return done.select(
        "doc_id",
        "source",
        F.col("info.title").alias("title"),
        F.size("text_pages").alias("n_pages"),
        chars.alias("chars"),
        F.get("text_pages", F.lit(1))["text"].alias("page_2"),
        rows.alias("n_rows"),
        "summary",
    )


@query(
    "doc_result_summary",
    f"""WITH {DOC_PAGES}, {DOC_TABLES}, texts AS (
    SELECT doc_id, count(*)::INTEGER AS pages_processed FROM doc_pages GROUP BY doc_id),
    found AS (SELECT doc_id, count_if(page_no <= n_pages)::INTEGER AS tables_extracted FROM doc_tables GROUP BY doc_id)
    SELECT doc_id, tables_extracted, false AS has_summary, pages_processed FROM texts JOIN found USING (doc_id)""",
)
def doc_result_summary(spark, folder):
    return reports.doc_result_summary(process_docs(derived.paged_documents(spark, folder)))


@query(
    "doc_tables",
    f"""WITH {ORDER_TABLES} SELECT doc_id, page_no, table_index, '' AS caption, array_to_string(headers, '|') AS headers,
    array_to_string([array_to_string(r, '|') for r in rows], ';') AS cells,
    len(rows)::INTEGER AS row_count, 3 AS col_count FROM shaped""",
)
def doc_tables(spark, folder):
    tables = grids.doc_tables(derived.order_grids(spark, folder))
    return tables.select(
        "doc_id", "page_no", "table_index", "caption", F.array_join("headers", "|").alias("headers"),
        flat("rows").alias("cells"), "row_count", "col_count",
    )


@query(
    "doc_tables_given_text",
    f"""WITH {DOC_TABLES} SELECT doc_id, page_no, array_to_string(headers, '|') AS headers,
    array_to_string([array_to_string(r, '|') for r in rows], ';') AS cells, row_count, col_count FROM doc_tables""",
)
def doc_tables_given_text(spark, folder):
    tables = grids.doc_tables(derived.paged_documents(spark, folder))
    return tables.select(
        "doc_id", "page_no", F.array_join("headers", "|").alias("headers"), flat("rows").alias("cells"),
        "row_count", "col_count",
    )


@query(
    "table_rows_long",
    f"""WITH {ORDER_TABLES}, padded AS (
    SELECT doc_id, page_no, table_index, coalesce(headers, ['col_0', 'col_1', 'col_2']) AS names,
           [CASE WHEN len(r) < 3 THEN list_append(r, '') ELSE r END for r in rows] AS rows FROM shaped)
    SELECT doc_id, page_no, table_index, (row_no - 1)::INTEGER AS row_no, (col_no - 1)::INTEGER AS col_no,
           names[col_no] AS header, value
    FROM padded, unnest(rows) WITH ORDINALITY AS r(cells, row_no), unnest(cells) WITH ORDINALITY AS c(value, col_no)""",
)
def table_rows_long(spark, folder):
    return grids.table_rows_long(grids.doc_tables(derived.order_grids(spark, folder)))


def _md(cells: str) -> str:
    return f"'| ' || array_to_string({cells}, ' | ') || ' |'"


MARKDOWN = f"""'### Page ' || page_no || ', Table ' || (table_index + 1) || {NL} || {NL} || {{head}} || {NL} ||
  '|---|---|---|' || {NL} || array_to_string([{{row}} for r in rows], {NL}) || {NL}"""


@query(
    "tables_markdown",
    f"""WITH {ORDER_TABLES} SELECT doc_id, page_no, table_index, {MARKDOWN.format(
        head=_md("coalesce(headers, ['Col 1', 'Col 2', 'Col 3'])"),
        row=_md("[replace(c, '|', chr(92) || '|') for c in CASE WHEN len(r) < 3 THEN list_append(r, '') ELSE r END]"),
    )} AS body FROM shaped""",
)
def tables_markdown(spark, folder):
    return grids.tables_markdown(grids.doc_tables(derived.order_grids(spark, folder)))


def _csv(cells: str) -> str:
    quoted = "CASE WHEN regexp_matches(c, '[\",]') THEN '\"' || replace(c, '\"', '\"\"') || '\"' ELSE c END"
    return f"array_to_string([{quoted} for c in {cells}], ',')"


@query(
    "tables_csv_rows",
    f"""WITH {ORDER_TABLES}, lines AS (
    SELECT doc_id, page_no, table_index,
      list_concat([['# Page ' || page_no || ' — Table ' || (table_index + 1)]], grid, [[]::VARCHAR[]]) AS lines FROM shaped)
    SELECT doc_id, page_no, table_index, (n - 1)::INTEGER AS seq, len(cells)::INTEGER AS n_cells, {_csv("cells")} AS line
    FROM lines, unnest(lines) WITH ORDINALITY AS u(cells, n)""",
)
def tables_csv_rows(spark, folder):
    lines = grids.tables_csv_rows(grids.doc_tables(derived.order_grids(spark, folder)))
    return lines.select("doc_id", "page_no", "table_index", "seq", F.size("cells").alias("n_cells"), "line")


# Parts of the reports on ``derived.paged_documents``, with the notice as summary.
NOTICE = "[Summarization needs a summary function; none was given.]"


def _report(texts: str, tables: str) -> str:
    return f"""WITH {DOC_PAGES}, {DOC_TABLES}, {texts}, {tables}, report AS (
  SELECT doc_id, 'https://docs.example.com/' || source || '/' || doc_id || '.pdf' AS source, texts, tables,
         full_text = '' AS no_text
  FROM documents JOIN texts USING (doc_id) JOIN tables USING (doc_id)
  JOIN (SELECT doc_id, string_agg(norm, '') AS full_text FROM doc_pages GROUP BY doc_id) USING (doc_id))"""


SUMMARY = f"CASE WHEN no_text THEN '[No text content found to summarize.]' ELSE '{NOTICE}' END"


@query(
    "doc_report_md",
    _report(
        texts=f"""texts AS (SELECT doc_id, string_agg('### Page ' || page_no || {NL} || {NL} ||
          CASE WHEN norm = '' THEN '_No text detected on this page._' ELSE norm END || {NL}, {NL} ORDER BY page_no) AS texts
          FROM doc_pages GROUP BY doc_id)""",
        tables=f"""tables AS (SELECT doc_id, string_agg('### Page ' || page_no || ', Table 1' || {NL} || {NL} ||
          '| ' || replace(array_to_string(coalesce(headers, ['Col 1', 'Col 2']), ' | '), 'source | place', 'source | place')
          || ' |' || {NL} || '|' || repeat('---|', col_count) || {NL} ||
          array_to_string([{_md("[replace(c, '|', chr(92) || '|') for c in list_concat(r, CASE WHEN len(r) < col_count THEN [''] ELSE [] END)]")}
                           for r in rows], {NL}) || {NL}, {NL} ORDER BY page_no) AS tables
          FROM doc_tables WHERE page_no <= n_pages GROUP BY doc_id)""",
    )
    + f""" SELECT doc_id, '# PDF Processing Report' || {NL} || {NL} || '| Field | Value |' || {NL} || '|---|---|' || {NL} ||
    '| Source | `' || source || '` |' || {NL} || '| Operation | `all` |' || {NL} || '| Pages | `all` |' || {NL} ||
    '| Generated | `{AT}` |' || {NL} || {NL} || '## AI Summary' || {NL} || {NL} || {SUMMARY} || {NL} || {NL} ||
    '## Extracted Text' || {NL} || {NL} || texts || {NL} || '## Tables' || {NL} || {NL} || tables AS body FROM report""",
)
def doc_report_md(spark, folder):
    return reports.doc_md(process_docs(derived.paged_documents(spark, folder)), AT)


@query(
    "doc_report_txt",
    _report(
        texts=f"""texts AS (SELECT doc_id, string_agg({NL} || '--- Page ' || page_no || ' ---' || {NL} ||
          CASE WHEN norm = '' THEN '(no text on this page)' ELSE norm END, {NL} ORDER BY page_no) AS texts
          FROM doc_pages GROUP BY doc_id)""",
        tables=f"""tables AS (SELECT doc_id, string_agg({NL} || '[Page ' || page_no || ', Table 1]' || {NL} ||
          coalesce('  ' || array_to_string(headers, ' | ') || {NL} || '  ' ||
                   array_to_string([repeat('-', length(h)) for h in headers], '-+-') || {NL}, '') ||
          array_to_string(['  ' || array_to_string(r, ' | ') for r in rows], {NL}), {NL} ORDER BY page_no) AS tables
          FROM doc_tables WHERE page_no <= n_pages GROUP BY doc_id)""",
    )
    + f""" SELECT doc_id, repeat('=', 60) || {NL} || 'PDF PROCESSING REPORT' || {NL} || repeat('=', 60) || {NL} ||
    'File:       ' || source || {NL} || 'Operation:  all' || {NL} || 'Pages:      all' || {NL} ||
    'Generated:  {AT}' || {NL} || repeat('=', 60) || {NL} || {NL} || '── AI SUMMARY ──' || {NL} || {NL} ||
    {SUMMARY} || {NL} || {NL} || '── EXTRACTED TEXT ──' || {NL} || texts || {NL} || {NL} || '── TABLES ──' || {NL} ||
    tables AS body FROM report""",
)
def doc_report_txt(spark, folder):
    return reports.doc_txt(process_docs(derived.paged_documents(spark, folder)), AT)


@query(
    "doc_report_json",
    f"""WITH {DOC_PAGES} SELECT d.doc_id, 'extract' AS op, '2-3' AS page_range,
    len(string_split(d.text, {NL}))::INTEGER AS total_pages, true AS summary_is_null,
    a.norm AS page_2, b.norm AS page_3, 0 AS n_tables
    FROM documents d LEFT JOIN doc_pages a ON a.doc_id = d.doc_id AND a.page_no = 2
    LEFT JOIN doc_pages b ON b.doc_id = d.doc_id AND b.page_no = 3""",
)
def doc_report_json(spark, folder):
    """The JSON bodies, read back: key order and escapes are not part of the format."""
    done = process_docs(derived.paged_documents(spark, folder), "extract", "2-3")
    bodies = reports.doc_json(done, AT)
    shape = (
        "metadata struct<op: string, page_range: string, total_pages: int>, summary string, "
        "text_pages map<string, string>, tables array<struct<page: int>>"
    )
    back = bodies.select("doc_id", "body", F.from_json("body", shape).alias("b"))
    return back.select(
        "doc_id",
        F.col("b.metadata.op").alias("op"),
        F.col("b.metadata.page_range").alias("page_range"),
        F.col("b.metadata.total_pages").alias("total_pages"),
        F.col("body").contains('"summary":null').alias("summary_is_null"),
        F.col("b.text_pages")["2"].alias("page_2"),
        F.col("b.text_pages")["3"].alias("page_3"),
        F.size("b.tables").alias("n_tables"),
    )


@query(
    "doc_report_rows",
    f"""WITH {DOC_PAGES}, {DOC_TABLES}, lines AS (
    SELECT doc_id, page_no AS block, n, cells FROM doc_tables,
      unnest(list_concat([['# Page ' || page_no || ', Table 1']], CASE WHEN headers IS NULL THEN [] ELSE [headers] END,
                         rows, [[]::VARCHAR[]])) WITH ORDINALITY AS u(cells, n) WHERE page_no <= n_pages
    UNION ALL SELECT doc_id, 8, n, cells FROM documents,
      unnest([['# Extracted Text'], ['page', 'text']]) WITH ORDINALITY AS u(cells, n)
    UNION ALL SELECT doc_id, 9, page_no, [page_no::VARCHAR, norm] FROM doc_pages
    UNION ALL SELECT doc_id, 10, n, cells FROM
      (SELECT doc_id, bool_and(norm = '') AS no_text FROM doc_pages GROUP BY doc_id),
      unnest([['# AI Summary'], [{SUMMARY}]]) WITH ORDINALITY AS u(cells, n))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY block, n) - 1)::INTEGER AS seq,
           len(cells)::INTEGER AS n_cells, array_to_string(cells, '|') AS cells FROM lines""",
)
def doc_report_rows(spark, folder):
    done = process_docs(derived.paged_documents(spark, folder))
    rows = reports.doc_report_rows(done)
    return rows.select("doc_id", "seq", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


@query("normalise_page", f"SELECT doc_id, {normalise("text || '  ' || chr(9) || 'x' || repeat(chr(10), 4) || ' y '")} AS text FROM documents")
def normalised(spark, folder):
    text = F.concat("text", F.lit("  \tx\n\n\n\n y "))
    return table(spark, folder, "documents").select("doc_id", normalise_page(text).alias("text"))
