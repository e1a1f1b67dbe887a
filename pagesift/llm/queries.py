"""The operators of this subpackage as queries over the given tables, with their SQL.

The SQL is DuckDB's. Queries without SQL are tested against plain versions of the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.chat import format_conversations, learned_text, read_back
from pagesift.llm.decontaminate import find_benchmark
from pagesift.llm.infill import fill_in_middle, restore
from pagesift.llm.likelihood import score_likelihood
from pagesift.llm.main_text import extract_main_text
from pagesift.llm.mixing import mixed_in_order
from pagesift.llm.neardup import near_duplicates
from pagesift.llm.phrases import mine_phrases
from pagesift.llm.pii import find_personal_data
from pagesift.llm.quality import held_out, score_quality
from pagesift.llm.repeats import remove_repeats
from pagesift.llm.revisits import captures_of, resolve_revisits
from pagesift.llm.simhash import search_every

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under a name."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op3_minmax_near_duplicates",
    f"""
WITH RECURSIVE
  docs AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
  sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
      ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s
    FROM docs),
  rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
  links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM rows a JOIN rows b USING (shingle)
    WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  reach AS (
    SELECT doc_id AS x, doc_id AS y FROM sets
    UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
  named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN named USING (doc_id)""",
)
def op3_minmax_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=2)


def _position(middle: str) -> str:
    """When the curriculum of a source takes the words around ``middle``: schedules (1, 1, 2),
    (2, 1, 1) and (1, 1, 1) in turn, in two steps each, linear in between."""
    d, cases = f"({middle} / target)", []
    for kind, (a, b, c) in enumerate(((1.0, 1.0, 2.0), (2.0, 1.0, 1.0), (1.0, 1.0, 1.0))):
        first, second = (a + b) / 4, (b + c) / 4
        for begin, left, low, high in ((0.0, f"({d} * {first + second}::DOUBLE)", a, b),
                                       (1.0, f"({d} * {first + second}::DOUBLE - {first}::DOUBLE)", b, c)):
            root = f"sqrt(greatest(0.0::DOUBLE, {low * low}::DOUBLE + {4 * (high - low)}::DOUBLE * {left}))"
            x = f"CASE WHEN {left} > 0 THEN 4.0::DOUBLE * {left} / ({root} + {low}::DOUBLE) ELSE 0.0::DOUBLE END"
            upto = first if begin == 0 else first + second
            cases.append(f"WHEN rank % 3 = {kind} AND {d} * {first + second}::DOUBLE < {upto}::DOUBLE "
                         f"THEN ({x} + {begin}::DOUBLE) / 2.0::DOUBLE")
    return f"CASE WHEN {middle} < target THEN least(CASE {' '.join(cases)} ELSE 1.0::DOUBLE END, 1.0::DOUBLE) END"


@query(
    "op10_curriculum_mix",
    f"""
WITH
  docs AS (
    SELECT doc_id, source, len(coalesce({_WORDS.format("text")}, []))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, 'text:' || text, '')) AS h
    FROM documents),
  placed AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size
                              ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
    FROM docs),
  sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
  ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes),
  weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank % 3 + 1)::INT] AS weight,
           source_size::DOUBLE * 2.0::DOUBLE AS cap,
           (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
    FROM ranked),
  levels AS (
    SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
              / sum(weight) OVER (ORDER BY cap / weight, rank
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
  level AS (SELECT arg_min(level, (cap / weight, rank)) AS level FROM levels WHERE level <= cap / weight),
  targets AS (
    SELECT source, source_size, rank, least(cap, coalesce(level.level * weight, cap)) AS target
    FROM weighed, level)
SELECT doc_id, size, source_size, target,
       size * (CASE WHEN one < target THEN 1 ELSE 0 END + CASE WHEN two < target THEN 1 ELSE 0 END)::BIGINT AS taken,
       {_position("one")} AS first_position, {_position("two")} AS second_position
FROM (SELECT *, start + size / 2.0::DOUBLE AS one, start + source_size + size / 2.0::DOUBLE AS two
      FROM placed JOIN targets ON placed.source IS NOT DISTINCT FROM targets.source)""",
)
def op10_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixed_in_order(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        "first_position",
        F.get("positions", F.lit(1)).alias("second_position"),
    )


@query("op6_quality_votes")
def op6_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


@query("op9_benchmark_hits")
def op9_benchmark_hits(spark: SparkSession, folder: str) -> DataFrame:
    found = find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    best = F.sort_array(F.transform("hits", lambda h: F.struct(h["score"], -h["item_id"])), asc=False)
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_items"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        F.get(best, F.lit(0))["score"].alias("best_score"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query("op2_personal_data")
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(table(spark, folder, "documents"))
    count = [
        F.regexp_count("base_spans", F.lit(rf"\b{kind}:")).cast("long").alias(f"n_{kind}")
        for kind in ("email", "ip", "card", "phone")
    ]
    return found.select("doc_id", *count, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


@query("op1_main_text")
def op1_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return search_every(table(spark, folder, "documents"))


@query(
    "op8_super_k_mer_repeats",
    f"""
WITH
  docs AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM docs),
  windows AS (
    SELECT doc_id, place AS i, string_agg(word, ' ') OVER w AS g, count(*) OVER w AS n FROM words
    WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
  firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows WHERE n = 13),
  covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM firsts WHERE least < doc_id),
  stay AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
    FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN stay USING (doc_id)""",
)
def op8_super_k_mer_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_masked_likelihood")
def op4_masked_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return score_likelihood(table(spark, folder, "documents"))


@query(
    "op5_revisits",
    r"""
WITH
  hashed AS (SELECT page_id, url, md5(html) AS h, 1700000000 + page_id * 7919 % 2592000 AS t, strlen(html) AS size FROM pages),
  captures AS (
    SELECT page_id * 4 AS record_id, url, t AS captured, 'response' AS kind,
           '"' || h || '"' AS etag, t::VARCHAR AS modified, 'max-age=60' AS cache, size FROM hashed
    UNION ALL SELECT page_id * 4 + 1, regexp_replace(url, '^http', 'HTTP'), t + 3600, 'revisit',
           'W/"' || h || '"', NULL, 'max-age=600', 0 FROM hashed
    UNION ALL SELECT page_id * 4 + 2, url || '#again', t + 7200, 'revisit', '"x' || h || '"', NULL, 'max-age=600', 0 FROM hashed
    UNION ALL SELECT page_id * 4 + 3, url, t - 100, 'revisit', NULL, t::VARCHAR, 'max-age=600', 0 FROM hashed),
  parts AS (
    SELECT *, regexp_extract(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)(/[^?]*)?(?:\?(.*))?$',
                             ['host', 'path', 'search'], 's') AS p
    FROM captures),
  keyed AS (
    SELECT *, regexp_replace(regexp_replace(lower(p.host), ':(80|443)$', ''), '^www\.', '')
              || regexp_replace(p.path, '/+$', '')
              || CASE WHEN p.search = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(p.search, '&')), '&') END AS key
    FROM parts),
  nearest AS (
    SELECT r.*, f.record_id AS response_id, f.etag AS old_etag, f.modified AS old_modified,
           f.cache AS old_cache, f.size AS old_size, f.captured AS old_captured
    FROM (SELECT * FROM keyed WHERE kind = 'revisit') r
    LEFT JOIN (SELECT * FROM keyed WHERE kind = 'response') f ON f.key = r.key AND f.captured < r.captured
    QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.captured DESC NULLS LAST, f.record_id DESC) = 1),
  judged AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'orphan'
        WHEN etag IS NOT NULL THEN
          CASE WHEN regexp_replace(etag, '^W/', '') = old_etag THEN 'resolved' ELSE 'mismatch' END
        WHEN modified = old_modified THEN 'resolved' ELSE 'mismatch' END AS status
    FROM nearest)
SELECT record_id, key AS canonical_url, captured, status, response_id,
       CASE WHEN status = 'resolved' THEN
         'cache-control: ' || cache || chr(10) || 'content-length: ' || old_size || chr(10)
         || 'content-type: text/html' || chr(10) || 'etag: ' || coalesce(etag, old_etag) || chr(10)
         || 'last-modified: ' || coalesce(modified, old_modified) END AS headers
FROM judged""",
)
def op5_revisits(spark: SparkSession, folder: str) -> DataFrame:
    resolved = resolve_revisits(captures_of(table(spark, folder, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(
        "record_id",
        "canonical_url",
        "captured",
        "status",
        "response_id",
        F.array_join(lines, "\n").alias("headers"),
    )


@query(
    "op11_piece_table_infill",
    r"""
WITH
  docs AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents),
  drawn AS (
    SELECT doc_id, t, u, len(u)::BIGINT AS n,
           ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
           CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM docs),
  cut AS (
    SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
           array_to_string(u[greatest(a, b) + 1:], '') AS s
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut""",
)
def op11_piece_table_infill(spark: SparkSession, folder: str) -> DataFrame:
    shown = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    back = restore(fill_in_middle(table(spark, folder, "documents")), carry=shown)
    return back.select(*[F.col(f"carry_{name}").alias(name) for name in shown], "restored_sha256")


_CONTROL = r"<\\*/?s>|\[\\*/?(?:INST|SYSTEM_PROMPT|ROLE|TEXT|TURN)\]"


@query(
    "op12_chat_transcripts",
    f"""
WITH
  rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  runs AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, t) AS before,
           length(t) + len(regexp_extract_all(t, '{_CONTROL}')) AS chars
    FROM rows),
  marked AS (
    SELECT *, CASE WHEN before = role THEN 6 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 5
                   WHEN role = 'system' THEN 33
                   ELSE 22 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS marks
    FROM runs)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars + marks))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""",
)
def op12_chat_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    tricky = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky)
    made = format_conversations(rows).withColumn("turns", read_back(F.col("formatted")))
    made = made.withColumn("learned", learned_text(F.col("segments")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op13_phrase_collocations",
    rf"""
WITH
  pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           regexp_extract_all(unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents),
  grams AS (
    SELECT lang, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]
                        || [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS phrase
    FROM pieces),
  f AS (SELECT lang, phrase, count(*) AS n FROM grams GROUP BY lang, phrase),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
  cands AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE n >= 10 AND contains(phrase, ' ')),
  cuts AS (SELECT *, unnest(range(1, len(w))) AS k FROM cands),
  scored AS (
    SELECT c.*, l.n AS l, r.n AS r, ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ')
                JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  longer AS (
    SELECT lang, phrase, max(a) AS most
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
          FROM cands WHERE len(w) = 3)
    GROUP BY lang, phrase),
  kept AS (
    SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 50 * a, true))
SELECT lang, rank, phrase, a, l, r, totals.n AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000""",
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return mine_phrases(table(spark, folder, "documents"))
