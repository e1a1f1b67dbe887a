"""Operators on odd rows and against plain versions of the same."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import likelihood, neardup, repeats
from pagesift.llm.decontaminate import align, find_benchmark
from pagesift.llm.graph import components
from pagesift.llm.likelihood import contexts, score_likelihood
from pagesift.llm.main_text import extract_main_text, main_text
from pagesift.llm.mixing import mix_sources, mixed_in_order, training_order
from pagesift.llm.neardup import near_duplicates
from pagesift.llm.pii import base_spans, find_personal_data
from pagesift.llm.quality import fit_quality, held_out, score_quality
from pagesift.llm.repeats import remove_repeats, repeated_windows
from pagesift.llm.revisits import canonical_url, resolve_revisits
from pagesift.llm.simhash import fingerprints, near_fingerprints, search_every
from pagesift.llm.text import Powers, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score int, spans int, node int, key int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, blanks, a very long text, repeated rows and ids, columns with clashing names."""
    long = prose(1, 60_000)
    rows = [
        (1, prose(2, 80), "en", "b", 1),
        (2, prose(2, 80), "en", "b", 1),
        (2, prose(2, 80), "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", None, 4),
        (6, long, "en", "a", None),
        (7, long + " end", "en", "a", None),
        (8, "one", "en", "c", 3),
        (None, prose(2, 80), "en", "b", 1),
        (None, None, None, None, None),
        (9, "é" * 3 + " \x00 \U0001f600 +1 (743) 555-3824", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*row, 1, 2, 3, 4, 5) for row in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def labels_of(spark, rows=((1, 1, 0), (8, 0, 0), (None, 1, 0), (6, None, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark_of(spark, rows=((1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "  "), (None, "Short one"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_every_operator_takes_odd_rows(spark, odd):
    n = odd.count()
    labels, benchmark = labels_of(spark), benchmark_of(spark)
    for out in (
        near_duplicates(odd),
        near_duplicates(odd, shingle=2),
        score_quality(odd, labels),
        find_benchmark(odd, benchmark),
        find_personal_data(odd),
        mix_sources(odd),
        score_likelihood(odd),
        search_every(odd),
        remove_repeats(odd),
    ):
        assert out.count() == n
        assert out.filter("doc_id is null").count() == 2


def test_every_operator_takes_empty_tables(spark, empty):
    labels, benchmark = labels_of(spark).filter("false"), benchmark_of(spark).filter("false")
    for out in (
        near_duplicates(empty),
        score_quality(empty, labels),
        find_benchmark(empty, benchmark),
        find_personal_data(empty),
        mix_sources(empty),
        training_order(empty),
        score_likelihood(empty),
        search_every(empty),
        remove_repeats(empty),
        extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ):
        assert out.count() == 0


def test_near_duplicates_of_odd_rows(odd):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd, shingle=2).collect()}
    assert {(1, 79, 1, True), (2, 79, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)} <= rows
    assert (None, 79, None, True) in rows and (8, 1, 8, True) in rows
    assert {r[2] for r in rows if r[0] in (6, 7)} == {6}


def brute_components(texts, percent=80):
    sets = {}
    for k, text in texts.items():
        words = text.lower().split()
        sets[k] = set(zip(words, words[1:], strict=False)) or ({tuple(words)} if words else set())
    group = {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def test_chains_of_edits_are_linked_as_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts, words = {}, prose(9, 60).split()
    for k in range(120):
        if k % 40 == 0:
            words = prose(100 + k, 60).split()
        words = list(words) if rng.random() < 0.7 else list(texts[rng.integers(0, k)].split()) if k else words
        for place in rng.integers(0, len(words), 3):
            words[place] = f"w{k}x{place}"
        texts[k] = " ".join(words)
    expected = brute_components(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, shingle=2).collect()}
    assert got == expected and len(set(expected.values())) < 120


@pytest.mark.parametrize("backwards", [False, True])
def test_an_id_with_two_texts_is_one_document(spark, backwards):
    """Near the one text is 9, near the other 11: all are linked, whatever the order of rows."""
    one, two = prose(31, 60), prose(32, 60)
    rows = [(5, one), (5, two), (9, one + " more"), (11, two + " words"), (12, prose(33, 60)), (5, one)]
    rows += [(20, prose(34, 60)), (20, prose(33, 60) + " end"), (21, prose(34, 60) + " x")]
    docs = spark.createDataFrame(rows[::-1] if backwards else rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, shingle=2).collect()}
    assert got == {(5, 5, True), (9, 5, False), (11, 5, False), (12, 12, True), (20, 12, False), (21, 12, False)}


def test_mix_is_range_sorted_by_position(spark, odd):
    out = mixed_in_order(odd)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan and "Arrow" not in plan
    rows = [r.first_position for r in out.collect()]
    assert len(rows) == odd.count() and rows == sorted(rows, key=lambda p: (p is not None, p))
    assert mixed_in_order(odd.filter("false")).count() == 0


def test_signatures_keep_both_ends():
    factors, summands = neardup.permutations(3)
    values = np.arange(1, 10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed = values * factors + summands
    expected = np.stack([hashed.min(axis=1), hashed.max(axis=1)], axis=1).ravel()
    assert (neardup.min_max_signature(values, factors, summands) == expected).all()


def test_components_of_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.component) for r in found} == {(n, 0) for n in range(41)} | {(n, 100) for n in range(100, 130)}


def test_words_of_long_texts_are_those_of_short_ones():
    powers, text = Powers(), (prose(3, 200_000) + " x\x0by\x0cz  ").encode()
    hashes, starts, ends = word_hashes(text, powers)
    assert [text[a:b] for a, b in zip(starts, ends, strict=True)] == text.split()
    assert (word_hashes(text[-600:], powers)[0][-90:] == hashes[-90:]).all()


def test_quality_tells_labels_apart(spark):
    docs = [(n, prose(n, 50) if n % 2 else " ".join(["Spam!!"] * 20 + [prose(n, 5)])) for n in range(200)]
    labels = labels_of(spark, [(n, n % 2, 0) for n in range(200)])
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = score_quality(docs, labels).withColumn("held", held_out()).filter("held").collect()
    assert len(rows) > 20 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)
    assert {r.score for r in score_quality(docs, labels.filter("false")).collect()} == {0.5}


def test_quality_learns_one_text_of_each_id(spark):
    rows = [(n % 3, prose(n, 20)) for n in range(60)] + [(2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = labels_of(spark, [(n, n % 2, 0) for n in range(3)] * 2)
    n_learned = labels.filter(~held_out()).select("doc_id").distinct().count()
    model = fit_quality(docs, labels)
    assert len(model.labels) == n_learned > 0
    again = fit_quality(docs.repartition(5), labels)
    assert (model.vectors == again.vectors).all()


def test_benchmark_copies_are_found(spark):
    item = prose(1, 30)
    words = item.split()
    changed = [w if k % 7 else "other" for k, w in enumerate(words)]
    docs = {
        1: prose(2, 100),
        2: f"{prose(3, 50)} {item.upper()} {prose(4, 50)}",
        3: f"{prose(5, 50)} {'!! '.join(changed)} {prose(6, 50)}",
        4: " ".join(words[:6]) + " " + prose(7, 90),
        5: "say short ONE, please",
    }
    docs = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    benchmark = benchmark_of(spark, [(1, item), (2, item), (3, None), (4, "Short one")])
    hits = {r.doc_id: {h.item_id: h for h in r.hits} for r in find_benchmark(docs, benchmark).collect()}
    assert {k: set(v) for k, v in hits.items()} == {1: set(), 2: {1, 2}, 3: {1, 2}, 4: set(), 5: {4}}
    assert hits[2][1].score == 1 and (hits[2][1].start, hits[2][1].end) == (50, 80)
    assert 0.6 < hits[3][1].score < 1


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, 20), rng.integers(0, 5, 12)
        table = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                fit = 2 if a[j] == b[i] else -1
                table[i + 1, j + 1] = max(0, table[i, j] + fit, table[i, j + 1] - 1, table[i + 1, j] - 1)
        score, first, last = align(a, b)
        assert score == table.max() and first <= last
        assert align(a[first : last + 1], b)[0] == score


def naive_base(text):
    """The contract's patterns, word for word."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(1)
    pieces = ["a", "b@", "@", "x.co", ".", "1", "23", "255.", "0.", " ", "-", "+", "(", ")", "+1 743 555", "4111 1111 1111 1111", "_", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        assert base_spans(text) == naive_base(text), text
    long = "1" * 200_000 + "@" * 50_000 + "a" * 200_000 + "+1" * 50_000 + "9." * 50_000
    assert isinstance(base_spans(long), list)


def test_personal_data_is_redacted(spark):
    text = "Call (743) 555-3824, mail jo@x.org or jo [at] mail [dot] com; Dr. Anna Meier said 555 times. phone (743) 555-3824"
    docs = spark.createDataFrame([(1, text)] * 30 + [(2, "plain text with 12 numbers 2024")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in find_personal_data(docs).collect()}
    assert rows[1].base_spans == "email:26:34"
    assert "phone:5:19" in rows[1].spans and rows[1].redacted.startswith("Call [PHONE], mail [EMAIL] or ")
    assert rows[2].spans == "" and rows[2].redacted == "plain text with 12 numbers 2024"


def test_mix_meets_targets(spark):
    rows = [(n, " ".join(["w"] * (n % 30 + 1)), None if n % 3 == 2 else f"s{n % 3}") for n in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix_sources(docs).collect()
    total = sum(r.size for r in mixed)
    targets = {}
    for r in mixed:
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) * r.size == r.taken
        assert all(0 <= p <= 1 for p in r.positions)
        targets.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6
    for (size, target), taken in targets.items():
        assert target <= 2 * size and abs(sum(taken) - target) <= 15
    ordered = [r.position for r in training_order(docs, ["doc_id"]).collect()]
    assert ordered == sorted(ordered) and len(ordered) == sum(len(r.positions) for r in mixed)


def test_rows_without_ids_are_spread_and_mixed(spark):
    rows = [(None, f"{prose(n, 1)} w", "a") for n in range(2000)] + [(n, "v", "b") for n in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mix_sources(docs, carry=["text"])
    nameless = mixed.filter("doc_id is null")
    # Their middles follow each other, so that no two have one position.
    places = [p for r in nameless.collect() for p in r.positions]
    assert len(places) > 2000 and len(set(places)) == len(places)
    again = mix_sources(docs.repartition(7), carry=["text"])
    assert sorted(map(str, again.collect())) == sorted(map(str, mixed.collect()))


def test_schedules_are_inverted(spark):
    docs = spark.createDataFrame([(n, "w", "a") for n in range(4000)], "doc_id bigint, text string, source string")
    mixed = mix_sources(docs, weights=(1,), share=1.0, schedules=((0, 2, 0),))
    positions = np.sort([p for r in mixed.collect() for p in r.positions])
    # A triangle over the training: half before the middle, an eighth before a quarter.
    assert abs((positions < 0.5).mean() - 0.5) < 0.01 and abs((positions < 0.25).mean() - 0.125) < 0.01


def plain_repeats(docs, window):
    first = {}
    for doc_id, text in sorted(docs):
        words = text.split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), doc_id)
    out = {}
    for doc_id, text in docs:
        words = text.split()
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < doc_id:
                gone.update(range(k, k + window))
        out[doc_id] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


@pytest.mark.parametrize("held", [5, 700_000])
def test_repeats_equal_the_plain_version(spark, held, monkeypatch):
    rng = np.random.default_rng(3)
    shared = [prose(s, 40) for s in range(4)]
    docs = []
    for n in range(150):
        parts = [prose(1000 + n, int(rng.integers(0, 30)))] + [shared[k] for k in rng.integers(0, 4, 2)] + ["a b " * 20]
        docs.append((int(n), "  ".join(parts)))
    docs.append((999, docs[3][1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, held=held).collect()}
    assert got == plain_repeats(docs, 13)
    everything = sorted(set(np.concatenate([repeats.super_k_mers(t.encode(), 13, 2, Powers())[3] for _, t in docs]).tolist()))
    hot = repeated_windows(df, hot=everything)
    cold = repeated_windows(df, hot=[])
    sizes = [x.select("doc_id", F.explode(F.expr("sequence(start, start + n - 1)")).alias("k")) for x in (hot, cold)]
    assert sorted(map(tuple, sizes[0].collect())) == sorted(map(tuple, sizes[1].collect()))


def test_next_documents_and_near_ones(spark):
    texts = {n: prose(n // 3, 60) + (" tail" if n % 3 else "") for n in range(0, 600)}
    texts[13] = ""
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in search_every(docs).collect()}
    order = sorted(texts, reverse=True)
    prints = {n: int(r.fingerprint, 16) for n, r in rows.items()}
    for k, n in enumerate(order):
        text, other = texts[n], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        assert rows[n].edited_sha256 == hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()
        near = sum((prints[n] ^ p).bit_count() <= 7 for p in prints.values()) - 1
        assert rows[n].n_near == (near if n % 20 == 0 else None)
    assert sum(r.near_edited for r in rows.values()) > 0
    one = fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = [int.from_bytes(rng.bytes(32), "big") for _ in range(5)]
    prints = [b ^ sum(1 << int(k) for k in rng.choice(256, rng.integers(0, 16), replace=False)) for b in base * 40]
    df = spark.createDataFrame([(f"{p:064x}",) for p in prints] + [(None,)], "fingerprint string")
    for radius, keys in ((3, 2), (10, 1), (12, 2)):
        got = {(r.fingerprint, r.other) for r in near_fingerprints(df, df, radius, keys).collect()}
        assert got == {(f"{a:064x}", f"{b:064x}") for a in prints for b in prints if (a ^ b).bit_count() <= radius}


def test_contexts_do_not_cross_documents():
    context, target = contexts([np.array([1, 2, 3], np.uint16), np.array([], np.uint16), np.array([4], np.uint16)])
    assert target.tolist() == [1, 2, 3, 4]
    assert context.tolist() == [[0, 0, 2, 3], [0, 1, 3, 0], [1, 2, 0, 0], [0, 0, 0, 0]]


def test_likelihood_prefers_what_the_corpus_says(spark):
    rng = np.random.default_rng(4)
    words = "the cat sat on a mat and then it ran".split()
    docs = [(n, " ".join(words * 200)) for n in range(60)]
    docs.append((100, " ".join(rng.permutation(words * 200))))
    rows = score_likelihood(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    score = {r.doc_id: r.mean_log_prob for r in rows}
    assert score[0] > score[100] + 0.5 and score[0] == pytest.approx(score[59])
    assert all(r.log_prob == pytest.approx(r.mean_log_prob * r.n_tokens) for r in rows)


def test_likelihood_learns_every_position(spark):
    # Words of a place of their own, so that a place never masked is a word never learned.
    text = " ".join(f"word{k}" for k in range(16))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    scores = {round(r.mean_log_prob, 6) for r in score_likelihood(docs).collect()}
    assert len(scores) == 1 and scores.pop() > -2


def test_a_training_step_takes_two_softmaxes(monkeypatch):
    """One over the groups and one over the members of all groups, with the right gradient."""
    rng, calls, plain = np.random.default_rng(3), [], likelihood._softmax
    monkeypatch.setattr(likelihood, "_softmax", lambda x: calls.append(len(x)) or plain(x))
    context, target = (rng.integers(0, likelihood.SIZE, shape).astype(np.uint16) for shape in ((500, 4), 500))
    model, squares = likelihood.fresh(), {name: np.zeros_like(v) for name, v in likelihood.fresh().items()}
    likelihood.train_step(context, target, model, squares, 0.0)
    assert calls == [500, 500]
    for name, at in (("members", (3, 5, 7)), ("words", (int(context[0, 1]), 2)), ("groups", (4, 6)), ("shift", (1,))):
        sides = []
        for step in (1e-2, -1e-2):
            moved = {key: values.astype(np.float64) for key, values in likelihood.fresh().items()}
            moved[name][at] += step
            sides.append(-likelihood.log_probabilities(context, target.astype(np.int64), moved).mean())
        slope = (sides[0] - sides[1]) / 2e-2
        assert abs(slope) == pytest.approx(squares[name][at] ** 0.5, rel=1e-2)


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Home</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="x"><div class="content"><h1>The &amp; title</h1>
<p><b>First   part<br>goes on<p>Second &eacute; <a href="#">link</a> text that is long enough to count as prose.
<ul><li>Item one<li>Item two</ul><form><input><p>Name</p></form>
<p>Third paragraph, also long enough to count as prose for the densities.</p></div>
<aside>Side</aside><div class="comments"><p>A reader writes a very long comment about all of this, twice.</p></div></div>
<footer>&copy; nobody</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text(PAGE).split("\n") == [
        "The & title",
        "First part goes on",
        "Second é link text that is long enough to count as prose.",
        "Item one",
        "Item two",
        "Third paragraph, also long enough to count as prose for the densities.",
    ]
    assert main_text("") == "" and main_text("<p>") == "" and main_text("plain words") == "plain words"
    assert main_text("<b>" * 50_000 + "</i>" * 50_000 + "<div>x" * 20_000).count("x") == 20_000


def test_canonical_urls(values):
    assert values(
        lambda c: canonical_url(c),
        ["HTTP://WWW.Ex.com:80/a//?b=2&a=1#f", "https://ex.com/", "https://ex.com?", "mailto:x", None, ""],
    ) == ["ex.com/a?a=1&b=2", "ex.com", "ex.com", "mailto:x", None, ""]


def test_revisits(spark):
    rows = [
        (1, "http://a.b/x", 100, "response", {"etag": '"1"', "content-type": "t", "expires": "old"}, "d1"),
        (2, "https://a.b/x/", 300_000, "revisit", {"etag": 'W/"1"', "expires": "new", "content-length": "0"}, None),
        (3, "http://a.b/x", 400_000, "response", {"last-modified": "m"}, "d2"),
        (4, "http://a.b/x", 400_000, "revisit", {"etag": '"2"'}, None),
        (5, "http://a.b/x", 400_001, "revisit", {"last-modified": "m"}, None),
        (6, "http://a.b/x", 900_000, "revisit", None, None),
        (7, "http://a.b/x", 50, "revisit", {}, None),
        (8, None, 500, "revisit", {}, None),
        (9, "http://a.b/x", 900_001, "revisit", None, "d2"),
        (10, "http://a.b/x", 10, "metadata", None, None),
    ]
    schema = "record_id bigint, url string, captured bigint, kind string, headers map<string,string>, payload_digest string"
    found = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert {k: (r.status, r.response_id) for k, r in found.items()} == {
        2: ("resolved", 1),
        4: ("mismatch", 1),
        5: ("resolved", 3),
        6: ("unverified", 3),
        7: ("orphan", None),
        8: ("orphan", None),
        9: ("resolved", 3),
    }
    assert found[2].headers == {"etag": 'W/"1"', "content-type": "t", "expires": "new"}
    assert found[2].payload_digest == "d1" and found[4].headers is None
    assert resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark, tmp_path, odd):
    import corpus_pipeline as pipeline

    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    benchmark_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = [(50, f"{prose(8, 30)} alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, *[0] * 5)]
    odd.union(spark.createDataFrame(leak, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        ids.append(sorted((r.doc_id or 0) for r in docs.select("doc_id").collect()))
    assert ids[0] == [0, 0, 1, 3, 4, 5, 6, 8, 9, 50] and 50 not in ids[1] and ids[2] == ids[1]
    assert docs.filter("doc_id = 9").first().text.endswith("[PHONE]")
    assert set(pipeline.run(spark, str(tmp_path)).columns) == {*pipeline.COLUMNS, "position"}
